"""Exact tokenizer ids by parts: a text is cut where no token can cross, each distinct part is encoded once.

Byte-level files ("byte"): a space that is followed by a character other than white space
always starts a pre-token, so parts cut before such spaces encode independently.
Word files ("word"): white space is dropped and never inside a pre-token, so parts are the
runs between ASCII white space. Tests compare both with the library on whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

_LOOSE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
SEGMENT = 1 << 20
#: Latin letters, then marks: two pre-tokens in either kind of file, normalised by lower() at most.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#]*)\Z")


def byte_letters() -> dict[int, str]:
    """Byte-level files write bytes as printable characters: those that are, as themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def segments(text: str, size: int = SEGMENT):
    """Cuts a very long text before spaces that are followed by no white space."""
    start = 0
    while len(text) - start > size:
        m = _CUT.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


class PartEncoder:
    """ids(texts) and counts(texts) with a bounded cache of parts (cleared when full)."""

    def __init__(self, path: str, kind: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.limit, self.lower = limit, kind == "word"
        self.letters = {i: c for i, c in byte_letters().items() if i > 127 or chr(i) != c}
        self.lead = "" if self.lower else byte_letters()[32]
        self.marks: dict[str, list[int]] = {}
        self.rest: dict = {}
        self.first: dict = {}

    def _known(self, cache: dict, lists: list[list], missing: set, lead: str, value_of) -> None:
        """Encodes what is missing for lists; what isn't plain goes to the library many parts in one call."""
        if len(cache) + len(missing) > self.limit:
            cache.clear()
            missing = {p for parts in lists for p in parts}
        todo, plain, model, marks = [], _PLAIN.match, self.tok.model.tokenize, self.marks
        start, lower = (self.lead, self.lower) if cache is self.rest else ("", False)
        for p in missing:
            text = p.decode() if lower else p
            m = plain(text) if start or lower else None
            if not m:
                todo.append(p)
                continue
            word, mark = m.groups()
            if lower:
                word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in model(start + word)]
            if mark:
                if mark not in marks:
                    if len(marks) > 10_000:
                        marks.clear()
                    marks[mark] = self.tok.encode(mark, add_special_tokens=False).ids
                ids += marks[mark]
            cache[p] = value_of(ids)
        for i in range(0, len(todo), 5000):
            some = todo[i : i + 5000]
            texts = [p.decode() if lower else lead + p for p in some]
            for p, e in zip(some, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
                cache[p] = value_of(e.ids)

    def _all(self, cache: dict, lists: list[list], join, lead: str, value_of) -> list:
        """join of the cached values of each list of parts."""
        out, late, missing, get = [], [], set(), cache.__getitem__
        for parts in lists:
            try:
                out.append(join(map(get, parts)))
            except KeyError:
                late.append(len(out))
                out.append(None)
                missing |= set(parts).difference(cache)
        if late:
            self._known(cache, [lists[i] for i in late], missing, lead, value_of)
            for i in late:
                out[i] = join(map(get, lists[i]))
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, for "byte" files."""
        heads, rests, owner = [], [], []
        for i, text in enumerate(texts):
            for k, seg in enumerate(segments(text)):
                parts = _CUT.split(seg) if _LOOSE.search(seg) else seg.split(" ")
                heads.append(parts[:1] if k == 0 else [])
                rests.append(parts[1:])
                owner.append(i)
        pack = lambda ids: array("I", ids).tobytes()
        heads = self._all(self.first, heads, b"".join, "", pack)
        rests = self._all(self.rest, rests, b"".join, " ", pack)
        found: list[list[bytes]] = [[] for _ in texts]
        for i, a, b in zip(owner, heads, rests):
            found[i] += (a, b)
        return [b"".join(x) for x in found]

    def counts(self, texts: list[str]) -> list[int]:
        """Number of ids of each text, for "word" files."""
        return self._all(self.rest, [t.encode().split() for t in texts], sum, "", len)


#: Fixed value: how byte-level files split texts before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on which the two libraries' tables agree (tests go through all of them).
_STRANGE = re.compile("[^\x00-\u024f\u2010-\u2027]")
_RUN = re.compile(r"\S{4000}|\s{400}")


class ByteEncoder:
    """ids(texts) of a byte-level file. Common texts go to a second library, with the ranks of the same file.

    It gives the same ids several times faster. Texts with characters outside common Latin,
    special strings or very long runs go to the first library by parts, and all texts do if
    the file's ids don't follow its merges. Of the common ones the first and every 128th of
    a process are encoded by both: a difference is an error.
    """

    def __init__(self, path: str):
        self.parts = PartEncoder(path, "byte")
        own = {c: i for i, c in byte_letters().items()}
        tok = self.parts.tok
        self.done = 0
        self.fast, self.special = None, [t.content for t in tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        if all(model["vocab"][m] == 256 + i for i, m in enumerate(merges)) and len(model["vocab"]) - len(merges) - 256 in (0, 1):
            import tiktoken

            ranks = {bytes(own[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
            self.fast = tiktoken.Encoding("same-ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _common(self, text: str) -> bool:
        if self.fast is None or not text.isascii() and _STRANGE.search(text):
            return False
        return not any(s in text for s in self.special) and (len(text) < 4000 or not _RUN.search(text))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list = [None] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if self._common(text):
                out[i] = b"".join(self.fast.encode_to_numpy(seg, disallowed_special=()).astype("<u4").tobytes() for seg in segments(text))
                if self.done % 128 == 0 and self.parts.ids([text])[0] != out[i]:
                    raise ValueError("the two libraries encode a text differently")
                self.done += 1
            else:
                slow.append(i)
        for i, ids in zip(slow, self.parts.ids([texts[i] for i in slow])):
            out[i] = ids
        return out


_ENCODERS: dict = {}


def encoder(path: str, kind: str) -> PartEncoder | ByteEncoder:
    """One encoder for each worker process and file."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = ByteEncoder(path) if kind == "byte" else PartEncoder(path, kind)
    return _ENCODERS[path, kind]
