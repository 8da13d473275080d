"""Token ids of whole texts with the tokenizers library, fast enough for a corpus.

Both kinds of vocabulary here cut a text before they merge, and never across the
start of a run of white space.  So a text is cut there first, ids of short
chunks are remembered (natural text repeats its words), and only chunks not
seen yet go through the library.  Ids are equal to those of one library call
on the whole text; a tokenizer of another build is called on whole texts, and so is
any tokenizer on a text that holds the string of one of its added tokens.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

REMEMBERED = 1_500_000   # chunks a worker remembers
TOGETHER = 200_000     # characters whose new chunks are encoded together
LONGEST = 48           # longer chunks are not remembered
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# any text: runs of white space start (byte) or separate (word) the chunks
_RULES = {"byte": re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+"), "word": re.compile(f"[^{_SPACE}]+")}
# ASCII text, and for words text of Latin letters (below U+0250, where classes of characters are
# settled and nothing is recomposed): the vocabulary's own pieces, of which there are far fewer kinds
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_ASCII = {"byte": re.compile(_SHORT + r"| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"),
          "word": re.compile(_SHORT + r"|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")}
_BEYOND_LATIN = re.compile("[\u0130\u0250-\U0010ffff]")   # U+0130 becomes two characters in lower case
_ALPHA = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xB5, 0xB5), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)))
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANK = "\t-\r \x85\xa0"
_LATIN_WORDS = re.compile(_SHORT + f"|[{_ALPHA}]+|[{_DIGIT}]|[^{_BLANK}{_ALPHA}{_DIGIT}]+")
TOGETHER_WORDS = 1000  # pieces that go through the library as one text, a blank between them


def _rule(path: str) -> str | None:
    """How texts may be cut into independent chunks; None: not at all."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    steps = pre.get("pretokenizers") or [{}]
    parts = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    if (parts == ["NFC", "Replace", "Lowercase"] and steps[0].get("type") == "Split" and steps[0].get("invert")
            and steps[0].get("behavior") == "Removed" and r"[^\s" in steps[0]["pattern"].get("Regex", "")):
        return "word"
    return None


def _bytes(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class Encoder:
    """``ids(text)`` as little-endian unsigned 32-bit bytes, what the tokenizer as it is
    loaded gives: no special tokens are added, and the string of one in a text is its id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.rule = _rule(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        # offsets are not needed, so the variant without them where there is one
        call = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        return [_bytes(e.ids) for e in call(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of the vocabulary's own pieces of text without white space: many go
        through the library as one text, which knows the tokens of each piece."""
        out: list[bytes] = []
        runs = [words[i:i + TOGETHER_WORDS] for i in range(0, len(words), TOGETHER_WORDS)]
        for run, e in zip(runs, self.tok.encode_batch([" ".join(r) for r in runs], add_special_tokens=False)):
            of = e.word_ids
            if not of or None in of or of[-1] + 1 != len(run):   # some piece is not one piece
                out += self._library(run)
                continue
            raw, ends, at = _bytes(e.ids), Counter(of), 0
            for k in range(len(run)):
                out.append(raw[at:at + 4 * ends[k]])
                at += 4 * ends[k]
        return out

    def _chunks(self, text: str) -> tuple[bool, list[str]]:
        """Chunks of a text, and whether they are the vocabulary's own pieces."""
        if any(t in text for t in self.added):
            return False, [text]
        if text.isascii():
            return True, _ASCII[self.rule].findall(text.lower() if self.rule == "word" else text)
        if self.rule == "byte" or _BEYOND_LATIN.search(text):
            return False, _RULES[self.rule].findall(text)
        return True, _LATIN_WORDS.findall(text.lower())

    def many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text in turn; new chunks of about ``TOGETHER`` characters of
        text go through the library in one call."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= TOGETHER:
                yield from self._some(held)
                held, size = [], 0
        yield from self._some(held)

    def _some(self, texts: list[str]) -> list[bytes]:
        if self.rule is None:
            return self._library(texts) if texts else []
        known = self.known
        cut = [self._chunks(t) for t in texts]
        parts = [list(map(known.get, chunks)) for _, chunks in cut]
        missing = [[i for i, p in enumerate(ps) if p is None] if None in ps else [] for ps in parts]
        own, new = set(), set()
        for (pieces, chunks), at in zip(cut, missing):
            (own if pieces and self.rule == "word" else new).update([chunks[i] for i in at])
        if own or new:
            own, new = list(own), list(new)
            ids = dict(zip(new, self._library(new)))
            ids.update(zip(own, self._words(own)))
            for (_, chunks), ps, at in zip(cut, parts, missing):
                for i in at:
                    ps[i] = ids[chunks[i]]
            if len(known) > REMEMBERED:
                known.clear()
            known.update((c, v) for c, v in ids.items() if len(c) <= LONGEST)
        return [b"".join(ps) for ps in parts]

    def ids(self, text: str | None) -> bytes:
        return self._some([text or ""])[0]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path)
