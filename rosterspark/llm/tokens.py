"""Byte-level BPE ids by the tokenizers library, with a bounded memory of words already encoded."""

from __future__ import annotations

import os
import re
import struct
import sys
import types

import numpy as np

#: The libraries' white space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where white space begins. A match of the split pattern holds white space only in front or throughout, so one always
#: ends here, whatever stands around it, and the parts can be encoded on their own and their ids joined.
SAFE_CUT = re.compile(rf"(?<=[^{WHITE}])(?=[{WHITE}])")
#: A text with one of these leaves the short way: white space side by side or of other kinds, and the mark of words after a line end.
LINE = "\0"
ODD = ["  ", "\n\n", " \n", "\n ", LINE, *"\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
#: Parts of the first 592 characters, and the split pattern for those, with its classes of letters and numbers spelled out.
LATIN = re.compile(r"[\x20-\x7e\n\u00a1-\u024f]*")
LETTERS, NUMBERS = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{WHITE}{LETTERS}{NUMBERS}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Ends of words that are a piece of their own after letters, whatever follows.
ENDS = frozenset(".,;:!?)")
#: Words that an encoder remembers, and as many again from before: some 170 MB.
REMEMBERED = 400_000
#: Texts whose ids are put together at once.
GATHERED = 500


class Known(dict):
    """Ids by text; ``make`` gives those of a new one. When it is full, it starts anew, but keeps the last one to take from."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.before.get(text)
        return self.take(text, self.make(text) if found is None else found)

    def take(self, text: str, found: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[text] = found
        return found


class FileEncoder:
    """``ids(texts)``: the ids of each text as little-endian unsigned 32-bit bytes, without special tokens.

    Special tokens' own strings in a text count as ordinary text. Texts are cut into words, each distinct one is looked up once a
    call; pieces of Latin words go straight to the library's merges, other words through the whole tokenizer, and both are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.merge = self.tokenizer.model.tokenize
        # The vocabulary spells bytes as characters: printable ones as themselves, the others from 256 on, in order.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.spelled = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.space = chr(self.spelled[32])
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(20)]
        self.whole = Known(lambda word: self._word(word, ""))  # parts as they stand
        self.inner = Known(lambda word: self._word(word, " "))  # words after a space
        self.line = self.whole["\n"]

    def _packed(self, spelled: str) -> bytes:
        ids = [t.id for t in self.merge(spelled)]
        return self.packs[len(ids)](*ids) if len(ids) < 20 else struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        return self._packed(piece.encode().decode("latin-1").translate(self.spelled))

    def _word(self, word: str, lead: str) -> bytes:
        """Ids of a part of a text, after a space or none. Letters alone are one piece, most others are put together from known words."""
        if word.isalpha():
            if word.isascii():
                return self._packed(self.space + word if lead else word)
            if LATIN.fullmatch(word):
                return self._piece(lead + word)
        elif lead and word[:1] == LINE:
            return self.line + self.whole[word[1:]]
        elif word.isascii() and word[-1:] in ENDS and word[:-1].isalpha():
            return (self.inner if lead else self.whole)[word[:-1]] + self.whole[word[-1]]
        return self._text(lead + word)

    def _text(self, text: str) -> bytes:
        if LATIN.fullmatch(text):
            pieces = SPLIT.findall(text)
            if len(pieces) == 1:
                return self._piece(text)
            # A piece after a space is remembered as the word it is, others by themselves.
            return b"".join([self.inner[p[1:]] if p[0] == " " and len(p) > 1 else self.whole[p] for p in pieces])
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = []
        for i, text in enumerate(texts):
            if any(map(text.__contains__, ODD)):
                out[i] = b"".join(map(self.whole.__getitem__, SAFE_CUT.split(text)))
            elif text:
                plain.append(i)
        for i, found in zip(plain, self._together([texts[i] for i in plain]), strict=True):
            out[i] = found
        return out

    def _learn(self, words: list[str]) -> None:
        """Remember those words (after a space) that are unknown and only letters of ASCII: most unknown ones, taken together."""
        inner, before, space = self.inner, self.inner.before, self.space
        new = [w for w in words if w not in inner and w not in before and w.isascii() and w.isalpha()]
        for word, tokens in zip(new, map(self.merge, [space + w for w in new]), strict=True):
            inner.take(word, self.packs[len(tokens)](*[t.id for t in tokens]) if len(tokens) < 20 else self._packed(space + word))

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts in which white space stands alone: words after single spaces, and after single line ends (marked)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        # As if each text stood after a line end, whose id is dropped: then every word has something in front of it.
        marked = pc.replace_substring(pa.array([LINE + t for t in texts], pa.large_string()), "\n", " " + LINE)
        lists = pc.split_pattern(marked, " ")
        ends = lists.offsets.to_numpy()[1:]
        coded = lists.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        self._learn(words)
        known = list(map(self.inner.__getitem__, words))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(known), "<u4")
        out = []
        for first in range(0, len(texts), GATHERED):
            a, some = 0 if first == 0 else int(ends[first - 1]), ends[first : first + GATHERED]
            here = at[a : int(some[-1])]
            counts = sizes[here]
            through = np.cumsum(counts)
            ids = data[np.repeat(begins[here] - (through - counts), counts) + np.arange(through[-1])]
            bounds = [0, *through[some - a - 1].tolist()]
            out += [ids[x + 1 : y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)]
        return out


def file_encoder(path: str) -> FileEncoder:
    """The encoder for a file that this Python worker already has, with what it remembers, or a new one."""
    state = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders")).__dict__
    key = f"{path}:{os.path.getmtime(path)}"
    if key not in state:
        state[key] = FileEncoder(path)
    return state[key]


def forget_words() -> None:
    """Free what encoders of earlier stages remember in this Python worker: for tasks that need the memory themselves."""
    sys.modules.pop("_token_encoders", None)


def slices(texts: list[str], most: int = 2_000_000):
    """Index ranges of about ``most`` characters, so that memory follows the text and not the row count."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
