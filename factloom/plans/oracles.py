"""SQL for the same results on the driver tables, for another engine to check.

Named pieces are put together as common table expressions; a query takes the ones it mentions.
"""

from __future__ import annotations

import re

from factloom import fixed_values as fv
from factloom.plans import testbed as tb
from factloom.plans.catalog import STYLE

WS = "'" + fv.WHITESPACE_CHARS + "'"
WS_CLASS = fv.WHITESPACE_CLASS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(items) -> str:
    return ", ".join(lit(i) for i in items)


def clean(x: str) -> str:
    for bad, good in fv.MOJIBAKE:
        x = f"replace({x}, {lit(bad)}, {lit(good)})"
    x = f"replace({x}, chr(13), chr(10))"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim({x}, {WS})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS_CLASS}]+', ' ', 'g'), {WS})"


def sentence_list(x: str) -> str:
    marked = (
        f"regexp_replace({collapse(x)}, '([.!?]) ([A-Z0-9\"''])', '\\1' || chr(1) || '\\2', 'g')"
    )
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s, ' -' || chr(9) || chr(10))),"
        f" lambda s: length(s) BETWEEN {fv.SENTENCE_MIN_CHARS} AND {fv.SENTENCE_MAX_CHARS})"
    )


def term_list(x: str) -> str:
    dropped = names([*fv.STOP_WORDS, *fv.DOMAIN_STOP_WORDS])
    return (
        f"list_filter(regexp_extract_all(lower({x}), {lit(fv.TERM_PATTERN)}), lambda w: w NOT IN ({dropped})"
        f" AND (length(w) > 2 OR w IN ({names(fv.SHORT_TERMS_KEPT)})))"
    )


def term_set(x: str) -> str:
    return f"list_distinct({term_list(x)})"


def dedup_key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' ')"


def garbage(x: str) -> str:
    controls = "".join(f"\\x{i:02x}" for i in range(32) if chr(i) not in "\n\r\t")
    bad = f"(length({x}) - length(regexp_replace({x}, '[\\x{{fffd}}{controls}]', '', 'g')))"
    marks = " + ".join(
        f"(length({x}) - length(replace({x}, '{m}', ''))) // {len(m)}" for m in ("endstream", "endobj")
    )
    return (
        f"(length({x}) > 0 AND ({bad} / greatest(length({x}), 1) > {fv.GARBAGE_RATIO}"
        f" OR {marks} > {fv.GARBAGE_STREAM_MARKERS}))"
    )


def numbers(x: str) -> str:
    return "list_concat(list_concat({}, {}), {})".format(
        *(
            f"regexp_extract_all({x}, {lit(p)})"
            for p in (fv.MONEY_PATTERN, fv.PERCENT_PATTERN, fv.COUNT_PATTERN)
        )
    )


def markers(x: str) -> str:
    return (
        f"list_distinct(list_concat(regexp_extract_all(lower({x}), {lit(fv.MARKER_PATTERN)}),"
        f" list_filter([{names(fv.MARKER_PHRASES)}], lambda p: contains(lower({x}), p))))"
    )


def marker_hits(ms: str, x: str) -> str:
    return f"len(list_filter({ms}, lambda m: contains(lower({x}), m)))"


def relation_name(x: str) -> str:
    kept = f"regexp_replace(upper(trim({x}, {WS})), '[^A-Za-z0-9_ ]+', '', 'g')"
    return f"coalesce(nullif(left(regexp_replace({kept}, ' +', '_', 'g'), 60), ''), 'RELATED_TO')"


def metric(x: str) -> str:
    return f"'metric:' || left({collapse(x)}, 90)"


def key(x: str) -> str:
    return f"regexp_replace(lower({clean(x)}), '[^a-z0-9]+', '', 'g')"


def generic(x: str) -> str:
    return f"(lower({x}) IN ({names(n.lower() for n in tb.GENERIC)}))"


def overlap(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def groups(text: str, conditions) -> str:
    parts = ["(" + " OR ".join(f"contains({text}, {lit(p)})" for p in g) + ")" for g in conditions]
    return " AND ".join(parts) or "true"


def _aliases() -> str:
    rows = []
    for rank, alias, e in tb.DICTIONARY.ranked_aliases:
        quoted = re.sub(r"([^A-Za-z0-9 ])", r"\\\1", alias)
        if alias in tb.DICTIONARY.unbounded:
            pattern = f"(?i){quoted}"
        else:
            pattern = f"(?i)(^|[^A-Za-z0-9]){quoted}([^A-Za-z0-9]|$)"
        rows.append(f"({rank}, {lit(e.name)}, {lit(e.type)}, {lit(alias)}, {lit(pattern)})")
    return ", ".join(rows)


def linked(table: str, ids: str, text: str) -> str:
    return (
        f"SELECT {ids}, entity, type, min(rank) AS alias_rank FROM {table} JOIN aliases"
        f" ON CASE WHEN contains(lower({text}), lower(alias)) THEN regexp_matches({text}, pattern) ELSE false END GROUP BY ALL"
    )


def _rule_facts() -> str:
    r = tb.RULES
    selects = []
    for i, rule in enumerate(r.subject_rules):
        target = metric(f"entity || {lit(f' {rule.kind}: ')} || array_to_string(list_slice(nums, 1, 3), ', ')")
        selects.append(
            f"SELECT entity AS source, {lit(rule.relation)} AS relation, {target} AS target,"
            f" {r.subject_weight} AS weight, sentence, doc_id, doc_seq, sent_idx, 1000000 + alias_rank * 100 + {i} AS sub FROM linked_numbers"
            f" WHERE type = {lit(r.subject_type)} AND len(nums) > 0 AND {groups('lower(sentence)', rule.groups)}"
        )
    for i, rule in enumerate(r.fixed_rules):
        selects.append(
            f"SELECT {lit(rule.source)}, {lit(rule.relation)}, {lit(rule.target)}, {r.fixed_weight}, sentence,"
            f" doc_id, doc_seq, sent_idx, 2000000 + {i} FROM linked_texts WHERE {groups('lower(sentence)', rule.groups)}"
            f" AND {groups('sentence', rule.verbatim)}"
        )
    for i, rule in enumerate(r.fan_rules):
        selects.append(
            f"SELECT {lit(rule.source)}, {lit(rule.relation)}, entity, {r.fan_weight}, sentence, doc_id, doc_seq,"
            f" sent_idx, {3 + i} * 1000000 + alias_rank FROM linked_numbers WHERE entity <> {lit(rule.source)}"
            f" AND {groups('lower(sentence)', rule.groups)}"
        )
    return " UNION ALL ".join(selects)


def tfidf_ctes(prefix: str, chunks: str, features: int) -> dict[str, str]:
    stop = names(fv.STOP_WORDS)
    words = f"list_filter(regexp_extract_all(lower({{}}), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{2,}}}}'), lambda w: w NOT IN ({stop}))"

    def terms(x: str) -> str:
        w = words.format(x).replace("{{", "{").replace("}}", "}")
        return (
            f"list_concat({w}, list_transform(list_zip(list_slice({w}, 1, len({w}) - 1), list_slice({w}, 2, len({w}))),"
            f" lambda p: p[1] || ' ' || p[2]))"
        )

    return {
        f"{prefix}_tf": f"SELECT doc_id, doc_seq, chunk_ix, term, count(*) AS tf FROM (SELECT doc_id, doc_seq, chunk_ix,"
        f" unnest({terms('text')}) AS term FROM {chunks}) GROUP BY ALL",
        f"{prefix}_vocab": f"SELECT term, sum(tf) AS cf, count(*) AS df, ln((1 + (SELECT count(*) FROM {chunks})) /"
        f" (1 + count(*))) + 1 AS idf FROM {prefix}_tf GROUP BY term ORDER BY cf DESC, term LIMIT {features}",
        f"{prefix}_raw": f"SELECT doc_id, doc_seq, chunk_ix, term, tf * idf AS w FROM {prefix}_tf JOIN {prefix}_vocab USING (term)",
        f"{prefix}_vec": f"SELECT doc_id, doc_seq, chunk_ix, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, chunk_ix)) AS w"
        f" FROM {prefix}_raw",
        f"{prefix}_qraw": f"SELECT qid, term, count(*) * any_value(idf) AS w FROM (SELECT qid, unnest({terms('question')}) AS term"
        f" FROM asked) JOIN {prefix}_vocab USING (term) GROUP BY qid, term",
        f"{prefix}_qvec": f"SELECT qid, term, w / sqrt(sum(w * w) OVER (PARTITION BY qid)) AS w FROM {prefix}_qraw",
        f"{prefix}_sim": f"SELECT qid, doc_id, doc_seq, chunk_ix, round(sum(v.w * q.w), 12) AS sim FROM {prefix}_vec v"
        f" JOIN {prefix}_qvec q USING (term) GROUP BY ALL HAVING round(sum(v.w * q.w), 12) > 0",
    }


def windows(size: int, stride: int, min_chars: int) -> str:
    return (
        "SELECT doc_id, doc_seq, k AS chunk_ix, text FROM (SELECT doc_id, doc_seq, k,"
        f" array_to_string(list_slice(s, k * {stride} + 1, k * {stride} + {size}), ' ') AS text FROM (SELECT doc_id, doc_seq, s,"
        f" unnest(range((len(s) + {stride - 1}) // {stride})) AS k FROM sentence_lists))"
        f" WHERE length(text) >= {min_chars}"
    )


def char_chunks(size: int) -> str:
    half = size // 2
    return f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS chunk_index, chunk FROM (
      WITH RECURSIVE cuts AS (
        SELECT doc_id, 0 AS step, text AS rest, CAST(NULL AS VARCHAR) AS chunk FROM docs WHERE length(text) > 0
        UNION ALL
        SELECT doc_id, step + 1, substring(rest, stop + 1), trim(substring(win, 1, stop), {WS}) FROM (
          SELECT *, CASE WHEN length(rest) > {size} AND brk - 1 > {half} THEN brk ELSE length(win) END AS stop FROM (
            SELECT *, greatest(
              CASE WHEN strpos(reverse(win), ' .') > 0 THEN length(win) - strpos(reverse(win), ' .') ELSE 0 END,
              CASE WHEN strpos(reverse(win), chr(10)) > 0 THEN length(win) - strpos(reverse(win), chr(10)) + 1 ELSE 0 END) AS brk
            FROM (SELECT *, left(rest, {size}) AS win FROM cuts WHERE length(rest) > 0))))
      SELECT * FROM cuts WHERE chunk <> '')"""


def chunk_key() -> str:
    return (
        "doc_id || ':' || chunk_index || ':' || length(chunk) || ':' || left(sha256(chunk), 16)"
    )


def answer_ctes(prefix: str, evidence: str) -> dict[str, str]:
    order = "score DESC, rank, pos"
    return {
        f"{prefix}_found": f"SELECT qid, rank, source_id, escore, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos"
        f" FROM (SELECT qid, rank, source_id, score AS escore, {sentence_list('text')} AS ss FROM {evidence})",
        f"{prefix}_scored": f"SELECT qid, rank, source_id, pos, sentence, escore + {overlap('q_terms', term_set('sentence'))} * 1.3 AS score"
        f" FROM {prefix}_found JOIN asked_terms USING (qid) UNION ALL SELECT qid, rank, source_id, 0, left(text, 650), score FROM {evidence}"
        f" WHERE qid NOT IN (SELECT qid FROM {prefix}_found)",
        f"{prefix}_once": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, {dedup_key('sentence')} ORDER BY {order}) AS copy"
        f" FROM {prefix}_scored) WHERE copy = 1",
        f"{prefix}_five": f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS place FROM {prefix}_once"
        f" QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {order}) <= 5",
        f"{prefix}_bare": f"SELECT qid, place, source_id, replace(replace(trim(regexp_replace(sentence, {lit(fv.ANSWER_PREFIX_PATTERN)}, ''), {WS}),"
        f" ' Supporting extraction:', ''), ' Supporting text:', '') AS part FROM {prefix}_five",
        f"{prefix}_cites": f"SELECT qid, string_agg(source_id, ', ' ORDER BY first) AS cites FROM (SELECT qid, source_id, min(place) AS first"
        f" FROM {prefix}_bare GROUP BY qid, source_id) GROUP BY qid",
        f"{prefix}_answers": f"SELECT a.qid, coalesce(b.body || ' Sources: ' || c.cites || '.', {lit(fv.NO_EVIDENCE_ANSWER)}) AS answer FROM asked a"
        f" LEFT JOIN (SELECT qid, string_agg(part, ' ' ORDER BY place) AS body FROM {prefix}_bare GROUP BY qid) b ON a.qid = b.qid"
        f" LEFT JOIN {prefix}_cites c ON a.qid = c.qid",
    }


def answer_score(answer: str) -> str:
    return (
        f"CASE WHEN len(q_terms) = 0 THEN 0.0 ELSE greatest(0.0, {overlap('q_terms', term_set(answer))} / len(q_terms)"
        f" + CASE WHEN contains({answer}, 'Sources:') THEN 0.25 ELSE 0.0 END"
        f" - CASE WHEN contains({answer}, 'No strong evidence') THEN 0.45 ELSE 0.0 END) END"
    )


ORD = "[doc_seq, sent_idx, sub]"
EDGE = "source, relation, target"
PLAIN = "source NOT LIKE 'doc:%' AND target NOT LIKE 'doc:%'"
TITLE_TAG = "regexp_extract(html, '<title>(.*?)</title>', 1)"

CTES: dict[str, str] = {
    "docs": f"SELECT 'doc_' || doc_id AS doc_id, doc_id AS doc_seq, {clean(clean('text'))} AS text FROM documents",
    "asked": "SELECT item_id AS qid, text AS question FROM benchmark",
    "asked_terms": f"SELECT qid, question, {term_set('question')} AS q_terms, {markers('question')} AS marks FROM asked",
    "sentence_lists": f"SELECT doc_id, doc_seq, {sentence_list('text')} AS s FROM docs",
    "sents": "SELECT doc_id, doc_seq, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sent_idx FROM sentence_lists",
    "aliases": f"SELECT * FROM (VALUES {_aliases()}) AS t(rank, entity, type, alias, pattern)",
    "doc_links": linked("docs", "doc_id, doc_seq", "text"),
    "sent_links": linked("sents", "doc_id, doc_seq, sent_idx, sentence", "sentence"),
    "linked_texts": "SELECT DISTINCT doc_id, doc_seq, sent_idx, sentence FROM sent_links",
    "linked_numbers": f"SELECT *, {numbers('sentence')} AS nums FROM sent_links",
    "ruled": _rule_facts(),
    "pairs": "SELECT a.entity AS source, 'CO_OCCURS_WITH' AS relation, b.entity AS target, 0.7 AS weight, a.sentence, a.doc_id,"
    " a.doc_seq, a.sent_idx, row_number() OVER (PARTITION BY a.doc_id, a.sent_idx ORDER BY a.entity, b.entity) AS sub FROM sent_links a JOIN sent_links b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND a.entity < b.entity",
    "facts": "SELECT entity AS source, 'MENTIONED_IN' AS relation, 'doc:' || doc_id AS target, CAST(0.4 AS DECIMAL(18,6)) AS weight,"
    " doc_id AS evidence, doc_id, doc_seq, -1 AS sent_idx, row_number() OVER (PARTITION BY doc_id ORDER BY alias_rank) AS sub FROM doc_links"
    " UNION ALL SELECT source, relation, target, CAST(weight AS DECIMAL(18,6)), sentence, doc_id, doc_seq, sent_idx, sub FROM pairs"
    " UNION ALL SELECT source, relation, target, CAST(weight AS DECIMAL(18,6)), sentence, doc_id, doc_seq, sent_idx, sub FROM ruled",
    "evidence_firsts": f"SELECT {EDGE}, evidence, min({ORD}) AS ord FROM facts WHERE evidence <> '' GROUP BY ALL",
    "evidence_ranked": f"SELECT *, row_number() OVER (PARTITION BY {EDGE} ORDER BY ord) AS rank FROM evidence_firsts"
    f" QUALIFY row_number() OVER (PARTITION BY {EDGE} ORDER BY ord) <= 4",
    "edge_evidence": f"SELECT {EDGE}, list(evidence ORDER BY rank) AS evidence FROM evidence_ranked GROUP BY ALL",
    "edge_base": f"SELECT {EDGE}, sum(weight) AS weight, arg_min(doc_id, {ORD}) AS title, min(doc_id) AS first_source,"
    f" count(DISTINCT doc_id) AS n_sources, min({ORD}) AS first_ord FROM facts GROUP BY ALL",
    "edges": "SELECT b.*, coalesce(e.evidence, []) AS evidence FROM edge_base b LEFT JOIN edge_evidence e USING (source, relation, target)",
    "sources": f"SELECT DISTINCT {EDGE}, doc_id FROM facts",
    "entity_nodes": "SELECT * FROM (VALUES "
    + ", ".join(f"({lit(e.name)}, {lit(e.type)}, {i})" for i, e in enumerate(tb.DICTIONARY.entities))
    + ") AS t(node, type, def_ord)",
    "nodes": "SELECT node, type, node AS label, coalesce(n, 0) AS mentions, CAST(NULL AS VARCHAR) AS title, [-1, -1, def_ord] AS node_ord"
    " FROM entity_nodes LEFT JOIN (SELECT entity AS node, count(*) AS n FROM sent_links GROUP BY entity) USING (node)"
    " UNION ALL SELECT 'doc:' || doc_id, 'Document', doc_id, 0, doc_id, [doc_seq, -1, 0] FROM docs"
    " UNION ALL SELECT target, 'Metric', replace(target, 'metric:', ''), count(*) - 1, NULL, min([doc_seq, sent_idx, sub]) FROM ruled"
    " WHERE target LIKE 'metric:%' GROUP BY target",
    "ordered_edges": "SELECT e.*, list_concat(n.node_ord, list_concat(min(first_ord) OVER (PARTITION BY source, target), first_ord)) AS edge_ord"
    " FROM edges e LEFT JOIN nodes n ON e.source = n.node",
    "star": "SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'IN_NATION' AS relation, 1 AS weight FROM customer"
    " UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'IN_NATION', 1 FROM supplier"
    " UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'IN_REGION', 1 FROM nation"
    " UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'SUPPLIES', count(*) FROM lineitem GROUP BY l_suppkey, l_partkey",
    "star_both": "SELECT source AS node, target AS neighbor FROM star UNION SELECT target, source FROM star",
    "flat": windows(fv.FLAT_WINDOW, fv.FLAT_STRIDE, fv.FLAT_MIN_CHARS),
    "guided": windows(fv.GUIDED_WINDOW, fv.GUIDED_STRIDE, fv.GUIDED_MIN_CHARS),
    **tfidf_ctes("ft", "flat", fv.FLAT_MAX_FEATURES),
    **tfidf_ctes("gt", "guided", fv.GUIDED_MAX_FEATURES),
    "flat_firsts": "SELECT * FROM flat ORDER BY doc_seq, chunk_ix LIMIT 5",
    "flat_all": "SELECT qid, doc_id, doc_seq, chunk_ix, sim FROM ft_sim UNION ALL SELECT qid, doc_id, doc_seq, chunk_ix, 0.0 FROM asked"
    " CROSS JOIN flat_firsts WHERE (qid, doc_id, chunk_ix) NOT IN (SELECT (qid, doc_id, chunk_ix) FROM ft_sim)",
    "flat_top": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc_seq, chunk_ix) AS rank FROM flat_all"
    " QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc_seq, chunk_ix) <= 5",
    "flat_ev": "SELECT qid, rank, doc_id AS source_id, text, sim AS score FROM flat_top JOIN flat USING (doc_id, chunk_ix)",
    "flat_sizes": "SELECT doc_id, doc_seq, chunk_ix, count(term) AS n FROM flat LEFT JOIN ft_vec USING (doc_id, doc_seq, chunk_ix) GROUP BY ALL",
    "q_sizes": "SELECT qid, count(term) AS n FROM asked LEFT JOIN ft_qvec USING (qid) GROUP BY qid",
    "flat_distances": "SELECT q.qid, f.doc_id, f.doc_seq, f.chunk_ix, 1 / (1 + ((CASE WHEN q.n > 0 THEN 1.0 ELSE 0.0 END)"
    " + (CASE WHEN f.n > 0 THEN 1.0 ELSE 0.0 END) - 2 * coalesce(s.sim, 0))) AS score FROM q_sizes q CROSS JOIN flat_sizes f"
    " LEFT JOIN ft_sim s ON s.qid = q.qid AND s.doc_id = f.doc_id AND s.chunk_ix = f.chunk_ix",
    "linked_seeds": "SELECT qid, entity AS node, type, alias_rank AS pos FROM (" + linked("asked", "qid", "question") + ")",
    "degree": "SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges) GROUP BY node",
    "fallback": f"SELECT qid, node, type, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node DESC) AS pos FROM (SELECT qid, node, type,"
    f" {overlap('q_terms', term_set('label'))} - CASE WHEN {generic('label')} THEN 0.75 ELSE 0.0 END - least(1.25, degree * 0.006) AS score"
    f" FROM asked_terms CROSS JOIN (SELECT nodes.*, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN degree USING (node) WHERE type <> 'Document')"
    f" WHERE {overlap('q_terms', term_set('label'))} > 0)",
    "all_seeds": "SELECT * FROM linked_seeds UNION ALL SELECT * FROM fallback WHERE pos <= 2 AND qid NOT IN (SELECT qid FROM linked_seeds)",
    "tiers": f"SELECT *, CASE WHEN type = 'Region' THEN 3 WHEN node IN ({names(tb.NOT_SPECIFIC)}) THEN 2 ELSE 1 END AS tier FROM all_seeds",
    "primary_only": "SELECT *, min(tier) OVER (PARTITION BY qid) AS best FROM tiers QUALIFY tier = min(tier) OVER (PARTITION BY qid)",
    "seed": "SELECT qid, node, pos FROM primary_only UNION ALL SELECT qid, node, pos + 1000000 FROM fallback WHERE pos <= 4"
    " AND qid IN (SELECT qid FROM primary_only WHERE best = 3) AND (qid, node) NOT IN (SELECT (qid, node) FROM primary_only)",
    "reach_docs": "SELECT qid, node, min(d) AS dist FROM (SELECT qid, node, 0 AS d FROM seed UNION ALL SELECT qid, neighbor, 1 FROM seed JOIN walk USING (node)"
    " UNION ALL SELECT s.qid, b.neighbor, 2 FROM seed s JOIN walk a ON s.node = a.node JOIN walk b ON b.node = a.neighbor) GROUP BY ALL",
    "walk": "SELECT source AS node, target AS neighbor FROM edges UNION SELECT target, source FROM edges",
    "scored": f"SELECT *, 5.0 * touches + greatest(0.0, 2.4 - 0.8 * dist) + (CASE WHEN relation IN ('CO_OCCURS_WITH', 'RELATED_TO') THEN 0.35 ELSE 1.8 END)"
    f" + least(2.0, 0.08 * CAST(weight AS DOUBLE)) + 1.45 * shared + 1.6 * hits - 1.2 * lone AS base_score FROM ("
    f" SELECT f.*, q_terms, {overlap('q_terms', 'row_terms')} AS shared, {marker_hits('marks', 'row_text')} AS hits FROM ("
    f" SELECT a.qid, e.source, e.relation, e.target, e.weight, e.first_source, e.evidence, e.edge_ord, least(a.dist, b.dist) AS dist,"
    f" CAST(a.dist = 0 OR b.dist = 0 AS INT) AS touches,"
    f" CAST({generic('e.source')} AND a.dist <> 0 AS INT) + CAST({generic('e.target')} AND b.dist <> 0 AS INT) AS lone,"
    f" concat_ws(' ', source, relation, target, array_to_string(evidence, ' || ')) AS row_text,"
    f" {term_set(chr(34) + 'row_text' + chr(34))} AS row_terms"
    f" FROM ordered_edges e JOIN reach_docs a ON a.node = e.source JOIN reach_docs b ON b.node = e.target AND b.qid = a.qid"
    f" WHERE relation <> 'MENTIONED_IN' AND least(a.dist, b.dist) <= 1) f JOIN asked_terms USING (qid))"
    f" WHERE NOT (shared = 0 AND relation = 'CO_OCCURS_WITH' AND touches = 0)",
    "fact_lines": f"SELECT qid, {EDGE}, base_score, first_source, edge_ord, q_terms, unnest(evidence) AS sentence, generate_subscripts(evidence, 1) AS pos FROM scored",
    "fact_items": f"SELECT qid, first_source AS source_id, sentence, edge_ord, pos, 'Graph fact: ' || source || ' -[' || relation || ']-> ' || target ||"
    f" '. Supporting extraction: ' || sentence AS text, base_score + 0.6 * {overlap('q_terms', term_set('sentence'))} AS score FROM fact_lines"
    f" WHERE length(sentence) >= 35 QUALIFY row_number() OVER (PARTITION BY qid, sentence ORDER BY edge_ord, pos) = 1",
    "guided_terms": f"SELECT doc_id, doc_seq, chunk_ix, text, {term_set('text')} AS terms FROM guided",
    "guided_flat_terms": "SELECT doc_id, doc_seq, chunk_ix, unnest(terms) AS term FROM guided_terms",
    "shared_terms": "SELECT qid, doc_id, doc_seq, chunk_ix, count(*) AS shared FROM guided_flat_terms JOIN"
    " (SELECT qid, unnest(q_terms) AS term FROM asked_terms) USING (term) GROUP BY ALL",
    "marker_pairs": "SELECT qid, doc_id, doc_seq, chunk_ix, count(*) AS markers FROM guided JOIN (SELECT qid, unnest(marks) AS m FROM asked_terms)"
    " ON contains(lower(text), m) GROUP BY ALL",
    "signals": "SELECT qid, doc_id, doc_seq, chunk_ix, coalesce(sim, 0.0) AS sim, coalesce(shared, 0) AS shared, coalesce(markers, 0) AS markers"
    " FROM gt_sim FULL JOIN shared_terms USING (qid, doc_id, doc_seq, chunk_ix) FULL JOIN marker_pairs USING (qid, doc_id, doc_seq, chunk_ix)",
    "relevance": "SELECT qid, doc_id, max(least(10.0, 18.0 * sim + 0.7 * shared + 1.4 * markers)) AS relevance FROM signals WHERE sim > 0 GROUP BY ALL",
    "votes": f"SELECT qid, doc_id, CAST(sum(greatest(1, CAST(round_even(base_score, 0) AS BIGINT))) AS BIGINT) AS votes FROM scored JOIN sources USING ({EDGE}) GROUP BY ALL",
    "boosts": f"SELECT qid, {EDGE}, max(coalesce(relevance, 0.0)) AS boost FROM scored JOIN sources USING ({EDGE}) LEFT JOIN relevance USING (qid, doc_id) GROUP BY ALL",
    "rows30": f"SELECT s.*, base_score + coalesce(boost, 0.0) AS score, row_number() OVER (PARTITION BY qid ORDER BY base_score + coalesce(boost, 0.0) DESC, edge_ord) AS rank"
    f" FROM scored s LEFT JOIN boosts USING (qid, {EDGE}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY base_score + coalesce(boost, 0.0) DESC, edge_ord) <= 30",
    "graph_terms": "SELECT DISTINCT qid, unnest(row_terms) AS term FROM rows30",
    "graph_shared": "SELECT qid, doc_id, doc_seq, chunk_ix, count(*) AS graph_shared FROM guided_flat_terms JOIN graph_terms USING (term) GROUP BY ALL",
    "chunk_pairs": "SELECT * FROM (SELECT qid, doc_id, doc_seq, chunk_ix, coalesce(sim, 0.0) AS sim, coalesce(shared, 0) AS shared, coalesce(markers, 0) AS markers,"
    " coalesce(graph_shared, 0) AS graph_shared FROM signals FULL JOIN graph_shared USING (qid, doc_id, doc_seq, chunk_ix))"
    " WHERE sim > 0 OR shared > 0 OR graph_shared >= 2",
    "chunk_scores": "SELECT qid, doc_id, doc_seq, chunk_ix, 20.0 * sim + 1.25 * shared + 0.25 * graph_shared + 2.2 * markers"
    " + (CASE WHEN votes IS NULL THEN 0.0 ELSE 2.2 END) + least(2.0, 0.05 * coalesce(votes, 0)) AS score FROM chunk_pairs LEFT JOIN votes USING (qid, doc_id)"
    " WHERE qid IN (SELECT qid FROM seed) AND (votes IS NOT NULL OR qid NOT IN (SELECT qid FROM votes))",
    "chunk_once": f"SELECT c.*, text, {dedup_key('text')} AS k FROM chunk_scores c JOIN guided g USING (doc_id, doc_seq, chunk_ix)"
    f" QUALIFY row_number() OVER (PARTITION BY qid, {dedup_key('text')} ORDER BY score DESC, doc_seq, chunk_ix) = 1",
    "chunk_items": "SELECT qid, doc_id AS source_id, 'Graph-guided supporting chunk: ' || text AS text, score,"
    " row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_seq, chunk_ix) AS pos FROM chunk_once"
    " WHERE (qid, k) NOT IN (SELECT (qid, sentence) FROM fact_items)"
    " QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_seq, chunk_ix) <= 8",
    "merged": "SELECT qid, source_id, text, score, 0 AS kind, edge_ord, pos FROM fact_items UNION ALL SELECT qid, source_id, text, score, 1, NULL, pos FROM chunk_items",
    "graph_ev": "SELECT qid, source_id, text, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, kind, edge_ord, pos) AS rank FROM merged"
    " QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, kind, edge_ord, pos) <= 10",
    **answer_ctes("fa", "flat_ev"),
    **answer_ctes("ga", "graph_ev"),
    "seed_names": "SELECT qid, string_agg(node, ', ' ORDER BY pos) AS query_entities FROM seed GROUP BY qid",
    "edge_texts": "SELECT qid, string_agg(source || ' -[' || relation || ']-> ' || target, ' | ' ORDER BY rank) AS top_graph_edges FROM rows30 WHERE rank <= 4 GROUP BY qid",
    "compared": "SELECT a.qid, q_terms, f.answer AS flat_answer, g.answer AS graphrag_answer FROM asked_terms a JOIN fa_answers f USING (qid) JOIN ga_answers g USING (qid)",
    "compared_scores": f"SELECT *, {answer_score('flat_answer')} AS fs, {answer_score('graphrag_answer')} AS gs FROM compared",
    "long_chunks": char_chunks(fv.CHUNK_CHARS),
    "cached": f"SELECT {chunk_key()} AS key, CAST(doc_id IN (SELECT 'doc_' || doc_id FROM labels) AS INT) AS hit FROM long_chunks",
    "visual": f"SELECT e.*, s.type AS st, t.type AS tt, CAST(weight AS DOUBLE) * CASE WHEN relation IN ('CO_OCCURS_WITH', 'RELATED_TO') THEN 0.22 ELSE 1 END AS vw"
    f" FROM ordered_edges e JOIN nodes s ON s.node = e.source JOIN nodes t ON t.node = e.target WHERE {PLAIN} AND relation <> 'MENTIONED_IN'",
    "visual_kept": "SELECT * FROM visual WHERE NOT (st = 'Metric' AND tt = 'Metric') AND NOT ((st = 'Metric' OR tt = 'Metric') AND NOT regexp_matches(relation,"
    f" {lit('|'.join(STYLE.metric_terms))})) AND NOT (relation = 'CO_OCCURS_WITH' AND round(vw, 9) < 0.45)",
    "semantic": "SELECT least(source, target) AS l, greatest(source, target) AS r, sum(vw) AS weight, string_agg(relation, '|' ORDER BY o) AS relations FROM"
    " (SELECT source, target, relation, sum(vw) AS vw, min(edge_ord) AS o FROM (SELECT least(source, target) AS source, greatest(source, target) AS target,"
    " relation, vw, edge_ord FROM visual_kept) GROUP BY ALL) GROUP BY ALL",
    "node_visual": "SELECT node, type, degree"
    f" + (CASE WHEN node IN ({names(STYLE.anchors)}) THEN 18.0 ELSE 0.0 END) + (CASE WHEN type IN ('Company', 'Policy', 'Organization') THEN 4.0 ELSE 0.0 END)"
    f" + (CASE WHEN type = 'Concept' THEN 2.0 ELSE 0.0 END) - (CASE WHEN type = 'Metric' THEN 5.0 ELSE 0.0 END)"
    f" - (CASE WHEN node IN ({names(STYLE.generic)}) AND node NOT IN ({names(STYLE.hubs)}) THEN 3.5 ELSE 0.0 END) AS score FROM"
    " (SELECT node, sum(weight) AS degree FROM (SELECT l AS node, weight FROM semantic UNION ALL SELECT r, weight FROM semantic) GROUP BY node) JOIN nodes USING (node)",
    "reply_rows": "SELECT o_orderkey AS k, o_custkey AS c, 'Cust ' || o_custkey AS source, ' placed-in ' || o_orderpriority AS relation,"
    " CASE WHEN o_orderkey % 11 = 0 THEN 'CUST ' || o_custkey ELSE 'Order ' || o_orderkey END AS target,"
    " CASE WHEN o_orderkey % 3 = 0 THEN 'Company' ELSE 'Entity' END AS source_type, CASE WHEN o_orderkey % 5 <> 0 THEN 'Order status ' || o_orderstatus ELSE '' END AS evidence,"
    " CASE o_orderkey % 7 WHEN 0 THEN 0.75 WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.5 ELSE 0.75 END AS confidence"
    " FROM orders WHERE o_orderkey % 13 = 0 OR o_orderkey % 17 <> 0",
    "triples": f"SELECT 'doc_' || c AS doc_id, c AS doc_seq, k AS chunk_index, source, {relation_name('relation')} AS relation, target, source_type, 'Metric' AS target_type,"
    " coalesce(nullif(evidence, ''), 'Customer ' || c) AS evidence, CAST(confidence AS DOUBLE) AS confidence, 'Customer ' || c AS title FROM reply_rows"
    " WHERE lower(source) <> lower(target)",
    "tfacts": "SELECT source, relation, target, greatest(0.25, confidence) AS weight, evidence, doc_id, title, [doc_seq, chunk_index, 0] AS ord FROM triples"
    " UNION ALL SELECT source, 'MENTIONED_IN', 'doc:' || doc_id, 0.2, title, doc_id, title, [doc_seq, chunk_index, 1] FROM triples"
    " UNION ALL SELECT target, 'MENTIONED_IN', 'doc:' || doc_id, 0.2, title, doc_id, title, [doc_seq, chunk_index, 2] FROM triples",
    "tfirsts": f"SELECT {EDGE}, evidence, row_number() OVER (PARTITION BY {EDGE} ORDER BY min(ord)) AS rank FROM tfacts WHERE evidence <> '' GROUP BY {EDGE}, evidence",
    "tedge_ev": f"SELECT {EDGE}, list(evidence ORDER BY rank) AS evidence FROM tfirsts WHERE rank <= 4 GROUP BY ALL",
    "tadds": "SELECT 'doc:' || doc_id AS node, 'Document' AS type, doc_id AS label, title, [doc_seq, chunk_index, 0] AS ord FROM triples"
    " UNION ALL SELECT source, source_type, source, NULL, [doc_seq, chunk_index, 1] FROM triples UNION ALL SELECT target, target_type, target, NULL, [doc_seq, chunk_index, 2] FROM triples",
    "names_found": "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][A-Za-z.]+')) AS given FROM docs",
    "alias_keys": f"SELECT {key('alias')} AS k, arg_min(entity, o) AS entity FROM (SELECT alias, a.entity, def_ord AS o FROM aliases a JOIN entity_nodes n ON a.entity = n.node)"
    f" WHERE {key('alias')} <> '' GROUP BY 1",
    "raw_pages": f"SELECT page_id, url, {TITLE_TAG} AS t, html, page_id % 3 = 0 AS bare, page_id % 5 = 0 AS headless FROM pages",
    "page_fields": f"SELECT page_id, 'page ' || page_id AS query, {clean('t')} AS title, {clean('url')} AS link,"
    f" CASE WHEN NOT bare THEN {clean(chr(39) + 'about ' + chr(39) + ' || t')} WHEN headless THEN {clean('split_part(html, chr(10), 1)')} ELSE 'Full Content:' END AS snippet,"
    f" CASE WHEN headless THEN '' WHEN {garbage('html')} THEN '' ELSE {clean('html')} END AS content FROM raw_pages",
    "judge_rows": "SELECT event_id AS qid, CASE WHEN event_id % 6 <> 0 THEN CAST(trunc(greatest(0.0, least(10.0, value))) AS INT) ELSE 0 END AS flat_score,"
    " CAST(least(10, event_id % 13) AS INT) AS graphrag_score, CASE event_type WHEN 'click' THEN 'GraphRAG' WHEN 'view' THEN 'FlatRAG' ELSE 'Tie' END AS winner,"
    " CAST(event_id % 4 = 0 AS INT) AS flat_hallucination, CAST(event_id % 9 = 0 AS INT) AS graphrag_hallucination, 'user ' || user_id AS reason FROM events",
    "centres": "SELECT label AS qid, list(x ORDER BY i) AS vec FROM (SELECT label, i, round(avg(CAST(x AS DOUBLE)), 9) AS x FROM (SELECT label, unnest(embedding) AS x,"
    " generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label",
    "vector_pairs": "SELECT qid, vec_id AS item_id, list_sum(list_transform(list_zip(vec, embedding), lambda p: p[1] * CAST(p[2] AS DOUBLE))) AS dot,"
    " list_sum(list_transform(vec, lambda x: x * x)) AS qn, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS n"
    " FROM centres CROSS JOIN embeddings",
    "vector_scores": "SELECT qid, item_id, round(dot / sqrt(n * qn), 9) AS cosine, round(1 / (1 + (n + qn - 2 * dot)), 9) AS score FROM vector_pairs",
}


def with_ctes(sql: str) -> str:
    """Put the pieces a query mentions, and the pieces those mention, before it."""
    words = {name: set(re.findall(r"\b[a-z_]\w*\b", body)) & set(CTES) - {name} for name, body in CTES.items()}
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in CTES:
            if other in words[name]:
                visit(other)
        ordered.append(name)

    used = set(re.findall(r"\b[a-z_]\w*\b", sql)) & set(CTES)
    for name in CTES:
        if name in used:
            visit(name)
    if not ordered:
        return sql
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in ordered) + "\n" + sql


EDGE_OUT = (
    "source, relation, target, CAST(weight AS DOUBLE) AS weight, n_sources, first_source, title, len(evidence) AS n_evidence,"
    " md5(array_to_string(evidence, ' || ')) AS evidence_digest"
)
SIMPLE = (
    "SELECT left_ AS \"left\", right_ AS \"right\", CAST(sum(weight) AS DOUBLE) AS weight, string_agg(relation, '|' ORDER BY o) AS relations FROM"
    " (SELECT least(source, target) AS left_, greatest(source, target) AS right_, relation, sum(weight) AS weight, min(edge_ord) AS o FROM ordered_edges {} GROUP BY 1, 2, 3)"
    " GROUP BY left_, right_"
)
VERDICT = (
    f"CASE WHEN contains(graphrag_answer, 'No strong evidence') AND contains(flat_answer, 'No strong evidence') THEN {lit(fv.VERDICT_BOTH_WEAK)}"
    f" WHEN gs >= fs + 0.18 AND fs < 0.42 THEN {lit(fv.VERDICT_GRAPH_OVER_WEAK_FLAT)} WHEN gs >= fs + 0.18 THEN {lit(fv.VERDICT_GRAPH)}"
    f" WHEN fs >= gs + 0.18 THEN {lit(fv.VERDICT_FLAT)} ELSE {lit(fv.VERDICT_EVEN)} END"
)
CHUNK_OUT = f"SELECT doc_id, chunk_ix, length(text) AS n_chars, md5(text) AS digest, md5({dedup_key('text')}) AS text_key FROM "
PART_NAME = "'  ' || p_name || chr(9) || ':  ' || p_type || ', 12%-off '"
TURN = (
    "SELECT conv_id, turn, text || ' sales in Q' || (turn % 5) || ' 20' || (conv_id % 100) || ' by ' || (turn % 7) || '.5%' AS text FROM conversations"
)

_FINAL: dict[str, str] = {
    "clean_text": f"SELECT doc_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT doc_id, {clean('text')} AS c FROM documents)",
    "garbage_filter": f"SELECT page_id, CAST({garbage('html')} AS INT) AS garbage FROM pages UNION ALL"
    f" SELECT -doc_id - 1, CAST({garbage('text')} AS INT) FROM documents",
    "header_fields": f"SELECT 'page_' || page_id AS doc_id, query, CASE WHEN title = '' THEN 'page_' || page_id ELSE title END AS title, link, snippet, length(content) AS content_chars,"
    f" md5({clean('concat_ws(chr(10), nullif(title, {0}), nullif(snippet, {0}), nullif(content, {0}))'.format(chr(39) * 2))}) AS text_digest FROM page_fields",
    "sentence_split": "SELECT doc_id, sent_idx, length(sentence) AS n_chars, md5(sentence) AS digest FROM sents",
    "content_term_freq": f"SELECT term, count(*) AS uses, count(DISTINCT doc_seq) AS docs FROM (SELECT doc_seq, unnest({term_list('text')}) AS term FROM docs) GROUP BY term",
    "number_extraction": f"SELECT id, len(n) AS found, array_to_string(n, '|') AS numbers FROM (SELECT id, {numbers('text')} AS n FROM (SELECT 'd' || doc_id AS id, text FROM documents"
    f" UNION ALL SELECT 'p' || page_id, html FROM pages)) WHERE len(n) > 0",
    "metric_and_relation_names": f"SELECT p_partkey, {metric('x || x || x')} AS metric, {relation_name('x')} AS relation, {relation_name('CAST(p_size AS VARCHAR)')} AS size_relation,"
    f" 'RELATED_TO' AS no_relation FROM (SELECT *, {PART_NAME} AS x FROM part)",
    "query_markers": f"SELECT conv_id, turn, array_to_string(list_sort(m), '|') AS markers, {marker_hits('m', 'nxt')} AS hits FROM (SELECT a.conv_id, a.turn, {markers('a.text')} AS m, coalesce(b.text, '') AS nxt"
    f" FROM ({TURN}) a LEFT JOIN ({TURN}) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)",
    "durations": "SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%.0f', s) || 's' WHEN s / 60 < 60 THEN printf('%.1f', s / 60) || ' minutes' ELSE printf('%.1f', s / 60 / 60) || ' hours' END AS duration,"
    " CAST(ceil(o_orderkey / 4) AS BIGINT) AS tokens FROM (SELECT *, o_totalprice / 10 + 0.03 AS s FROM orders)",
    "flat_chunks": CHUNK_OUT + "flat",
    "guided_chunks": CHUNK_OUT + "guided",
    "char_chunks": f"SELECT doc_id, chunk_index, {chunk_key()} AS key FROM long_chunks",
    "char_chunks_small": f"SELECT doc_id, chunk_index, {chunk_key()} AS key FROM ({char_chunks(900)})",
    "entity_links_documents": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY alias_rank) - 1 AS pos, entity, alias_rank FROM doc_links",
    "entity_links_sentences": "SELECT doc_id, entity, count(*) AS sentences FROM sent_links GROUP BY ALL",
    "entity_links_by_join": "SELECT doc_id, entity, alias_rank FROM doc_links",
    "entity_resolution": f"SELECT given, coalesce(a.entity, {clean('given')}) AS name, coalesce(n.type, 'Entity') AS type FROM names_found LEFT JOIN alias_keys a ON a.k = {key('given')}"
    f" LEFT JOIN entity_nodes n ON n.node = coalesce(a.entity, {clean('given')})",
    "cooccurrence_edges": f"SELECT {EDGE_OUT} FROM edges WHERE relation = 'CO_OCCURS_WITH'",
    "pattern_facts": "SELECT source, relation, target, doc_id, count(*) AS facts, CAST(sum(weight) AS DOUBLE) AS weight FROM ruled GROUP BY ALL",
    "graph_edges": f"SELECT {EDGE_OUT} FROM edges",
    "edge_sources": "SELECT * FROM sources",
    "graph_nodes": "SELECT node, type, label, mentions, title FROM nodes",
    "simple_graph": SIMPLE.format(f"WHERE {PLAIN}"),
    "simple_graph_with_documents": SIMPLE.format(""),
    "graph_counts": "SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges",
    "relation_histogram": "SELECT relation, count(*) AS edges FROM edge_base GROUP BY relation ORDER BY count(*) DESC, relation LIMIT 12",
    "star_degrees": "SELECT node, count(*) AS degree, CAST(sum(weight) AS DOUBLE) AS weighted_degree FROM (SELECT source AS node, weight FROM star UNION ALL SELECT target, weight FROM star) GROUP BY node",
    "star_walk": "SELECT qid, node, min(d) AS dist FROM (SELECT r_regionkey AS qid, 'r' || r_regionkey AS node, 0 AS d FROM region"
    " UNION ALL SELECT r_regionkey, neighbor, 1 FROM region JOIN star_both ON node = 'r' || r_regionkey"
    " UNION ALL SELECT r_regionkey, b.neighbor, 2 FROM region JOIN star_both a ON a.node = 'r' || r_regionkey JOIN star_both b ON b.node = a.neighbor) GROUP BY ALL",
    "star_components": "SELECT node, min(node) OVER (PARTITION BY n) AS component FROM (SELECT 'c' || c_custkey AS node, c_nationkey AS n FROM customer"
    " UNION SELECT 's' || s_suppkey, s_nationkey FROM supplier UNION SELECT 'n' || c_nationkey, c_nationkey FROM customer UNION SELECT 'n' || s_nationkey, s_nationkey FROM supplier"
    " UNION SELECT 'o' || o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey)",
    "semantic_edges": f"SELECT l AS \"left\", r AS \"right\", round(weight, 6) AS weight, relations, round(weight + 0.08 * a.score + 0.08 * b.score"
    f" + (CASE WHEN l IN ({names(STYLE.anchors)}) OR r IN ({names(STYLE.anchors)}) THEN 3.0 ELSE 0.0 END)"
    f" - (CASE WHEN l IN ({names(STYLE.hubs)}) OR r IN ({names(STYLE.hubs)}) THEN 3.8 ELSE 0.0 END)"
    f" - (CASE WHEN relations IN ('CO_OCCURS_WITH', 'RELATED_TO') THEN 1.0 ELSE 0.0 END)"
    f" - (CASE WHEN a.type = 'Metric' OR b.type = 'Metric' THEN 0.6 ELSE 0.0 END), 6) AS score FROM semantic JOIN node_visual a ON a.node = l JOIN node_visual b ON b.node = r",
    "visual_node_scores": "SELECT node, type, round(score, 6) AS score FROM node_visual",
    "edge_export": "SELECT e.source, e.relation, e.target, CAST(round(weight, 3) AS DOUBLE) AS weight, md5(s) AS sources_digest, md5(array_to_string(evidence, ' || ')) AS evidence_digest FROM edges e JOIN"
    f" (SELECT {EDGE}, string_agg(doc_id, '|' ORDER BY doc_id) AS s FROM sources GROUP BY ALL) USING (source, relation, target)",
    "triples_round_trip": "SELECT source, relation, target, CAST(weight AS DOUBLE) AS weight, n_sources, first_source, len(evidence) AS n_evidence FROM edges",
    "triple_coercion": "SELECT doc_id, chunk_index, source, relation, target, source_type, target_type, evidence, confidence FROM triples",
    "malformed_replies": "SELECT CAST(o_orderkey % 13 <> 0 AND o_orderkey % 17 = 0 AS INT) AS malformed, count(*) AS replies FROM orders GROUP BY 1",
    "triple_graph_edges": "SELECT source, relation, target, CAST(w AS DOUBLE) AS weight, n_sources, first_source, title, len(evidence) AS n_evidence, md5(array_to_string(evidence, ' || ')) AS evidence_digest"
    f" FROM (SELECT {EDGE}, sum(CAST(weight AS DECIMAL(18,6))) AS w, count(DISTINCT doc_id) AS n_sources, min(doc_id) AS first_source, arg_min(title, ord) AS title FROM tfacts GROUP BY ALL)"
    f" JOIN tedge_ev USING ({EDGE})",
    "triple_graph_nodes": "SELECT node, arg_min(type, ord) AS type, arg_min(label, ord) AS label, count(*) - 1 AS mentions, max(title) AS title FROM tadds GROUP BY node",
    "cache_latest": "SELECT 'user:' || user_id AS key, arg_max(event_type, event_id) AS source, arg_max(props, event_id) AS target FROM events GROUP BY user_id",
    "cache_split": "SELECT key, hit FROM cached",
    "work_estimate": "SELECT t AS total_chunks, h AS cached_chunks, t - h AS uncached_chunks, q * 3 AS benchmark_calls, t - h + q * 3 AS total_llm_calls, 10.0::DOUBLE AS seconds_per_call,"
    " (t - h + q * 3) * 10 AS estimated_seconds FROM (SELECT CAST(count(*) AS DOUBLE) AS t, CAST(sum(hit) AS DOUBLE) AS h, (SELECT CAST(count(*) AS DOUBLE) FROM asked) AS q FROM cached)",
    "tfidf_vocabulary": "SELECT term, round(idf, 6) AS idf FROM ft_vocab",
    "tfidf_vectors": "SELECT doc_id, chunk_ix, count(term) AS n_terms, round(coalesce(sum(w), 0.0), 6) AS weight_sum FROM flat LEFT JOIN ft_vec USING (doc_id, doc_seq, chunk_ix) GROUP BY ALL",
    "flat_topk": "SELECT qid, rank, source_id, md5(text) AS digest, round(score, 6) AS score FROM flat_ev",
    "flat_topk_distance": "SELECT qid, row_number() OVER w AS rank, d.doc_id AS source_id, md5(text) AS digest, round(score, 6) AS score FROM flat_distances d JOIN flat USING (doc_id, chunk_ix)"
    " WINDOW w AS (PARTITION BY qid ORDER BY score DESC, d.doc_seq, d.chunk_ix) QUALIFY row_number() OVER w <= 5",
    "nearest_vectors": "SELECT CAST(qid AS BIGINT) AS qid, row_number() OVER w AS rank, item_id, round(cosine, 6) AS cosine, round(score, 6) AS score FROM vector_scores"
    " WINDOW w AS (PARTITION BY qid ORDER BY score DESC, item_id) QUALIFY row_number() OVER w <= 5",
    "evidence_lines": f"SELECT qid, length(t) AS n_chars, md5(t) AS digest FROM (SELECT qid, string_agg('[' || rank || '] source=' || source_id || '; title=' || source_id || '; evidence=' || {collapse('text')}, chr(10) ORDER BY rank) AS t"
    f" FROM flat_ev GROUP BY qid)",
    "seeds": "SELECT * FROM seed_names",
    "fact_scores": "SELECT qid, source, relation, target, round(base_score, 6) AS base_score FROM scored",
    "fact_evidence": "SELECT qid, source_id, md5(text) AS digest, round(score, 6) AS score FROM fact_items",
    "doc_relevance": "SELECT qid, doc_id, round(relevance, 6) AS relevance FROM relevance",
    "source_votes": "SELECT * FROM votes",
    "vector_index_search": "SELECT qid, rank, item_id, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, item_id) AS rank FROM"
    " (SELECT q.vec_id AS qid, i.vec_id AS item_id, round(list_dot_product(q.e, i.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(i.e, i.e))), 9) AS cosine"
    " FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) i)) WHERE rank <= 10",
    "vector_index_recall": "SELECT count(*) AS queries, CAST(1 AS BIGINT) AS recall_reached FROM embeddings WHERE vec_id % 20 = 0",
    "case_list": "SELECT qid, question, top_graph_edges AS evidence_edges FROM asked JOIN edge_texts USING (qid) WHERE qid <= 10",
    "top_rows": "SELECT qid, rank, source, relation, target, round(score, 6) AS score FROM rows30 WHERE rank <= 10",
    "graph_evidence": "SELECT qid, rank, source_id, md5(text) AS digest, round(score, 6) AS score FROM graph_ev",
    "flat_answers": "SELECT * FROM fa_answers",
    "benchmark_compare": f"SELECT c.qid, coalesce(query_entities, '') AS query_entities, flat_answer, graphrag_answer, round(fs, 3) AS flat_score, round(gs, 3) AS graphrag_score, {VERDICT} AS verdict,"
    " coalesce(top_graph_edges, '') AS top_graph_edges FROM compared_scores c LEFT JOIN seed_names USING (qid) LEFT JOIN edge_texts USING (qid)",
    "judgements": "SELECT * FROM judge_rows",
    "judgement_summary": "SELECT count(*) FILTER (winner = 'FlatRAG') AS flat_wins, count(*) FILTER (winner = 'GraphRAG') AS graph_wins, count(*) FILTER (winner = 'Tie') AS ties,"
    " CAST(sum(flat_hallucination) AS BIGINT) AS flat_hallucinations, CAST(sum(graphrag_hallucination) AS BIGINT) AS graph_hallucinations, round(avg(flat_score), 6) AS flat_mean,"
    " round(avg(graphrag_score), 6) AS graph_mean FROM judge_rows",
    "label_quality_of_evidence": "SELECT quality, toxic, count(*) AS evidence FROM flat_ev JOIN labels ON source_id = 'doc_' || labels.doc_id GROUP BY ALL",
}

# Columns the other engine would give as 32-bit integers.
_WIDENED: dict[str, str] = {
    "garbage_filter": "garbage",
    "entity_links_documents": "alias_rank",
    "entity_links_by_join": "alias_rank",
    "star_walk": "qid dist",
    "malformed_replies": "malformed",
    "cache_split": "hit",
    "judgements": "flat_score graphrag_score flat_hallucination graphrag_hallucination",
    "label_quality_of_evidence": "quality toxic",
}


def _widened(name: str, sql: str) -> str:
    columns = _WIDENED.get(name, "").split()
    if not columns:
        return sql
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


ORACLES = {name: with_ctes(_widened(name, sql)) for name, sql in _FINAL.items()}

# A graph grown from stored parts is the graph of all documents.
ORACLES["grown_graph_edges"] = ORACLES["triple_graph_edges"]
ORACLES["grown_graph_nodes"] = ORACLES["triple_graph_nodes"]
# An index of stored parts is the index of all documents.
ORACLES["stored_flat_topk"] = ORACLES["flat_topk"]
