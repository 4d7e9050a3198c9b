"""Token ids of whole texts, batch-encoded by distinct stretches between white space.

The tokenizers of this kind drop white space and never join what it separates, so a text may be cut at
any run of space and U+0009..U+000D: its ids are those of its stretches in order.  Each distinct stretch
of a batch is encoded once, and a bounded memory of stretches is kept in the worker.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

from factloom.llm.common import release

REMEMBERED = 400_000  # stretches kept in a worker at most; then the memory starts anew
BATCH = 1 << 20  # characters of neighbouring texts that are encoded at once
LONGEST = 256  # longer stretches are encoded each time
AT_ONCE = 1 << 18  # characters of a long text that are encoded at once, to the next white space
_STRETCH = re.compile(r"[^\x20\x09-\x0D]+")
_GAP = re.compile(r"[\x20\x09-\x0D]")
# Letters of the lower half of the code space that no normal form changes; signs without the apostrophe,
# which has rules of its own, and without "<", which may begin a special string.
_LATIN = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[0-9!-&(-/:;=-@\\[-`{{-~{_LATIN}]+")
_PARTS = re.compile(f"[{_LATIN}]+|[0-9]|\n|[^0-9\n{_LATIN}]+")


class StretchEncoder:
    """Ids by a tokenizers file whose normalizer folds white space and whose splitter drops it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = (chr(c) for c in range(0xC0, 0x100))
        self.spelled = {ord(c): bytewise.pre_tokenize_str(c)[0][0] for c in letters}

    def _plain(self, stretches: list[str]) -> Iterator[bytes]:
        """Runs of letters, single digits and runs of signs are what the splitter makes of plain text."""
        parts, model = self.parts, self.tokenizer.model
        held: list[bytes] = []
        for part in _PARTS.findall("\n".join([*stretches, ""]).lower()):
            if part == "\n":
                yield b"".join(held)
                held = []
                continue
            ids = parts.get(part)
            if ids is None:
                coded = part if part.isascii() else part.translate(self.spelled)
                ids = parts[part] = array("I", [t.id for t in model.tokenize(coded)]).tobytes()
            held.append(ids)

    def _encoded(self, stretches: Iterable[str]) -> dict[str, bytes]:
        plain, other = [], []
        for s in stretches:
            (plain if _PLAIN.fullmatch(s) else other).append(s)
        fresh = dict(zip(plain, self._plain(plain)))
        for s, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            fresh[s] = array("I", e.ids).tobytes()
        return fresh

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit numbers of this machine's order."""
        if len(self.known) > REMEMBERED or len(self.parts) > REMEMBERED:
            self.known, self.parts = {}, {}
        stretches = [_STRETCH.findall(t) for t in texts]
        known = self.known
        fresh = self._encoded(set().union(*stretches).difference(known))
        known.update(fresh if max(map(len, fresh), default=0) <= LONGEST else {s: i for s, i in fresh.items() if len(s) <= LONGEST})
        try:
            return [b"".join(map(known.__getitem__, words)) for words in stretches]
        except KeyError:  # some are too long to remember
            return [b"".join([known[s] if s in known else fresh[s] for s in words]) for words in stretches]

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a text of any length, in portions cut at white space."""
        at = 0
        while len(text) - at > AT_ONCE:
            gap = _GAP.search(text, at + AT_ONCE)
            end = gap.start() if gap else len(text)
            yield self.encode_all([text[at:end]])[0]
            at = end
        yield self.encode_all([text[at:] if at else text])[0]


@lru_cache(maxsize=4)
def encoder(path: str) -> StretchEncoder:
    """One encoder per worker and file; reading the file takes more memory than is kept."""
    found = StretchEncoder(path)
    release()
    return found


def by_bytes(texts: Iterable[str], limit: int, sizes: Iterable[int] | None = None) -> Iterator[list[str]]:
    """Neighbouring texts in portions of about ``limit`` of their sizes, characters by default; a longer text is alone."""
    portion: list[str] = []
    held = 0
    for text, size in zip(texts, sizes) if sizes is not None else ((t, len(t)) for t in texts):
        if portion and held + size > limit:
            yield portion
            portion, held = [], 0
        portion.append(text)
        held += size
    if portion:
        yield portion


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
