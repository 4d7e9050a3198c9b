"""Plain versions of the contracts of conversations, archives and fill-in-the-middle."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import zlib

SPACE = " \t\n\v\f\r"


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    """(conv, turn, role, text) after damage, in the order of the rows."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(key.encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        out.extend([(conv, turn, role, text)] * (2 if how == 3 else 1))
    return out


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        if not bare:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def best_repair(initials, found):
    """(cost, audit): least cost, then least audit, by trying all edits."""

    @functools.cache
    def rest(i, state, put_in):
        options = [(0, "")] if i == len(initials) and state in ("", "a") else []
        if put_in < 3:
            for c, to in NEXT[state].items():
                if c in "ua" and (x := rest(i, to, put_in + 1)):
                    options.append((x[0] + 3, "I" + x[1]))
        if i < len(initials):
            extra = 3 if found[i] == "truncated" else 0
            if x := rest(i + 1, state, 0):
                options.append((x[0] + 4, "D" + x[1]))
            if found[i] not in ("blank", "duplicate"):
                for c, to in NEXT[state].items():
                    x = rest(i + 1, to, 0)
                    if x and c == initials[i]:
                        options.append((x[0] + extra, "K" + x[1]))
                    if x and c in "ua":
                        options.append((x[0] + 3 + extra, "R" + x[1]))
        return min(options, default=None)

    return rest(0, "", 0)


def repaired(rows, audit):
    """Lines of the repaired conversation."""
    state, at, lines = "", 0, []
    for edit in audit:
        made = next((c for c in NEXT[state] if c in "ua"), None)
        if edit == "I":
            lines.append({"u": "user:", "a": "assistant:"}[made])
            state = made
            continue
        _, _, role, text = rows[at]
        at += 1
        if edit == "D":
            continue
        if edit == "R":
            role, state = {"u": "user", "a": "assistant"}[made], made
        else:
            state = role[0]
        lines.append(f"{role}:{text}")
    assert at == len(rows)
    return lines


def conversation(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of rows in order."""
    found = faults(rows)
    initials = [r[2][:1] for r in rows]
    turns = sorted({r[1] for r in rows if r[1] is not None})
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = best_repair(tuple(initials), found)
    counts = [found.count(x) for x in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, sha256("\n".join(repaired(rows, audit))))


def archived(pages):
    """(page_id, bytes, digest, type, refers_to), for distinct ids."""
    first = {}
    for i, html in pages:
        first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, html in pages:
        raw, to = (html or "").encode(), first[html or ""]
        name = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), name, "response" if to == i else "revisit", None if to == i else to))
    return out


def fill_middle(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha256(text), sha256(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha256(out), sha256(text)
