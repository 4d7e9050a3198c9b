"""Bands of token fertility: against a plain recomputation, and with planted noise."""

import base64
import math
import random
import re
import string
from collections import Counter, defaultdict

from factloom.llm import fertility
from factloom.llm.tokens import vocabulary
from factloom.llm.scripts import dominant
from tests.llm import brute

RULES = fertility.Rules()


def planted(spark, sf):
    rng = random.Random(8)
    clean = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    clean = [t for t in clean if t and not brute.quality(t)[-1]]

    def words(alphabet, n):
        return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(3, 10))) for _ in range(n))

    kinds = {
        "letters": [words(string.ascii_lowercase, rng.randint(60, 300)) for _ in range(60)],
        "punctuation": [words(string.punctuation, rng.randint(60, 300)) for _ in range(60)],
        "base64": [base64.b64encode(rng.randbytes(1500)).decode().replace("/", " ").replace("+", " ") for _ in range(60)],
        "repeats": [f"{words(string.ascii_lowercase, 9)}. " * 40 for _ in range(60)],
    }
    kinds["base64"] = [" ".join(t[i : i + 40] for i in range(0, len(t), 40)) for t in kinds["base64"]]
    rows = [(i, kind, t) for i, (kind, t) in enumerate([("clean", t) for t in clean] + [(k, t) for k, ts in kinds.items() for t in ts])]
    # One text a third of all rows: copies do not move the bands.
    rows += [(len(rows) + i, "clean", clean[0]) for i in range(len(rows) // 2)]
    rows += [(len(rows) + i, "odd", t) for i, t in enumerate([None, "", "a", "7 " * 500, "слово дело " * 3, "Σ " * 30])]
    return spark.createDataFrame(rows, "doc_id long, script string, text string").repartition(5), rows


def plainly(rows):
    """kept by id, from one encoding of each whole word list and lists of values."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(RULES.vocabulary))
    found, values = {}, defaultdict(dict)
    for i, _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        ids = [x for w in words for x in model.encode(w)]
        n, counts = len(ids), Counter(ids)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) / math.log2(n) if n > 1 else 1.0
        shares = sum(map(model.is_byte, ids)) / n if n > 1 else 0.0
        failed = brute.quality(text)[-1]
        found[i] = (failed, n, dominant(text or ""), len("".join(words)) / max(n, 1), shares, entropy)
        if not failed and n >= RULES.least_tokens:
            values[found[i][2]][text] = found[i][3:5]

    def quartiles(xs):
        xs = sorted(math.floor(min(x, 64) * 200) for x in xs)
        return [xs[math.ceil(k * len(xs) / 4) - 1] for k in (1, 2, 3)]

    kept = {}
    for i, (failed, n, script, chars, shares, entropy) in found.items():
        if failed or n < RULES.least_tokens or script == "none":
            kept[i] = not failed and n < RULES.least_tokens
            continue
        band = RULES.bands.get(script, RULES.other)
        low, mid, high = quartiles([c for c, _ in values[script].values()])
        far = 2 * max(mid - low, high - mid, 0.1 * mid)
        _, b_mid, b_high = b = quartiles([s for _, s in values[script].values()])
        b_far = 2 * max(b_mid - b[0], b_high - b_mid, 10)
        kept[i] = (
            max(band.least_chars, (mid - far) / 200) <= chars <= min(band.most_chars, (mid + 1 + far) / 200)
            and shares <= min(band.most_bytes, (b_mid + 1 + b_far) / 200)
            and entropy >= band.least_entropy
        )
    return kept


def test_bands(spark, sf):
    df, rows = planted(spark, sf)
    found = {r.doc_id: r for r in fertility.judge(df).collect()}
    assert {i: r.kept for i, r in found.items()} == plainly(rows)
    share = {}
    for kind in ("clean", "letters", "punctuation", "base64", "repeats"):
        of_kind = [found[i].kept for i, k, _ in rows if k == kind]
        share[kind] = sum(of_kind) / len(of_kind)
    assert share["clean"] >= 0.98, share
    assert max(share[k] for k in ("letters", "punctuation", "base64", "repeats")) <= 0.05, share


def test_few_texts(spark):
    text = "Plain words of a single text are their own band. " + " ".join(f"Sentence {i} says something else again." for i in range(40))
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert not fertility.judge(one).first().base_failed
    assert fertility.judge(one).first().kept and fertility.judge(one.limit(0)).count() == 0
