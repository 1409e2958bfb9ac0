"""Token ids of whole texts by a public tokenizer, with a cache of the ids of pieces that are encoded alike anywhere."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import compress, repeat
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loomwork.llm.common import parts, texts_buffer

#: Pieces of one generation of the cache; when it is full it becomes the old one, and pieces still in use move on.
CACHE_PIECES = 300_000
_TOGETHER = 500

#: White space as Python's \s has it, written out.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD_SPACE = rf"[ \n]{_SPACE}|{_SPACE}[ \n]|\x00"
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: ASCII marks but the apostrophe, which may belong to the letter after it.
_STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def plain(word: str) -> bool:
    """Letters alone, also in the composed lower-case form that a tokenizer may read: there some letters become a letter and a mark."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


#: Latin letters that stay one letter.
_LATIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if plain(c))
#: A mark after the letter or digit that ends a word.
WORD_AND_MARK = re.compile(rf"[0-9A-Za-z{_LATIN}][{re.escape(_STOPS)}]")


def strings(column: pa.Array) -> list[str]:
    """``to_pylist`` in less time."""
    return column.to_numpy(zero_copy_only=False).tolist()


def apart(pieces: pa.Array) -> tuple[list[str], list[str], np.ndarray]:
    """Pieces without the marks after their last word, those marks, and the places of the pieces that had them: a word and the marks after it are tokens of their own."""
    bodies = pc.ascii_rtrim(pieces, _STOPS)
    at = np.flatnonzero(pc.binary_length(bodies).to_numpy() != pc.binary_length(pieces).to_numpy())
    words = bodies.take(pa.array(at))
    ends = pc.match_substring_regex(words, rf"[0-9A-Za-z{_LATIN}]\z").to_numpy(zero_copy_only=False)
    at, words, out = at[ends], strings(words.filter(pa.array(ends))), strings(pieces)
    marks = []
    for k, word in zip(at.tolist(), words, strict=True):
        marks.append(out[k][len(word) :])
        out[k] = word
    return out, marks, at


class Pool:
    """Ids of numbered strings, one after another in one buffer."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids, self.ends = np.empty(1 << 12, "<u4"), np.zeros(1 << 10, np.int64)  # ends in bytes

    def __len__(self) -> int:
        return len(self.at)

    def numbers(self, some: list[str]) -> np.ndarray:
        """-1 for what is not here."""
        return np.fromiter(map(self.at.get, some, repeat(-1)), np.int64, len(some))

    def add(self, some: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self), len(self) + len(some)
        used = int(self.ends[n]) // 4
        if m >= len(self.ends):
            self.ends = np.concatenate((self.ends, np.empty(m, np.int64)))
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(used + len(ids), "<u4")))
        self.ids[used : used + len(ids)] = ids
        self.ends[n + 1 : m + 1] = self.ends[n] + 4 * np.cumsum(sizes)
        self.at.update(zip(some, range(n, m), strict=True))

    def take(self, numbers: np.ndarray) -> pa.Array:
        """Ids of each number as bytes."""
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.ends), pa.py_buffer(self.ids)]).take(pa.array(numbers))


def flat(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of rows of bytes, and the ends of the rows in ids, from 0."""
    ends = np.frombuffer(rows.buffers()[1], np.int64)[: len(rows) + 1] // 4 if len(rows) else np.zeros(1, np.int64)
    return np.frombuffer(rows.buffers()[2] or b"", "<u4")[: ends[-1]], ends


class Memory:
    """Ids of pieces in two generations: when the new one is full it becomes the old one, and pieces still in use move on.

    ``encode`` gives different pieces, in any order, with all their ids and the number of ids of each.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], most: int):
        self.encode, self.most, self.new, self.old = encode, most, Pool(), Pool()

    def numbers(self, some: list[str]) -> np.ndarray:
        """The number of each piece in the new generation."""
        if len(self.new) > self.most:
            self.new, self.old = Pool(), self.new
        out = self.new.numbers(some)
        lack = np.flatnonzero(out < 0)
        if len(lack):
            lacking = [some[i] for i in lack.tolist()]
            different = list(dict.fromkeys(lacking))
            was = self.old.numbers(different)
            if (kept := was[was >= 0]).size:
                ids, ends = flat(self.old.take(kept))
                self.new.add([p for p, i in zip(different, was.tolist(), strict=True) if i >= 0], ids, np.diff(ends))
            if len(kept) < len(different):
                self.new.add(*self.encode([p for p, i in zip(different, was.tolist(), strict=True) if i < 0]))
            out[lack] = self.new.numbers(lacking)
        return out

    def rows(self, bodies: list[str], marks: list[str], at: np.ndarray) -> pa.Array:
        """Ids of ``bodies``, with those of ``marks`` after the ones that stand at ``at``, as bytes."""
        found, n = self.numbers([*bodies, *marks, ""]), len(bodies)
        if not len(at):
            return self.new.take(found[:n])
        two = np.full((n, 2), found[-1])
        two[:, 0], two[at, 1] = found[:n], found[n:-1]
        both = self.new.take(two.ravel())
        ends = np.frombuffer(both.buffers()[1], np.int64)[: 2 * n + 1 : 2].copy()
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends), both.buffers()[2]])


class Encoder:
    """Ids of texts whose pieces, cut at spaces and line ends, can be encoded apart.

    ``lead`` is what a word piece begins with. New words are encoded many at a time: a word of letters alone is one word to the
    tokenizer too, and the ids at which words end (or begin) are known from the vocabulary.
    """

    def __init__(self, path: str, lead: str, most: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.special = [x.content.lower() for x in self.t.get_added_tokens_decoder().values()]
        self.mark = commonprefix(self.special)
        self.lead, self.most = lead, most
        self.forget()
        self.simple = rf"^[ \n]{'' if lead else '?'}[A-Za-z{_LATIN}]+\z"
        self.fold = np.arange(256, dtype=np.uint8)
        if not lead:  # white space and case are dropped anyway
            self.fold[ord("A") : ord("Z") + 1] += 32
            self.fold[ord("\n")] = ord(" ")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level pieces show these bytes as they are, the others from 256 on
        hidden = [x for x in range(256) if x not in shown]
        self.shown = {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(hidden)}
        self.bytes_as = "".join(self.shown[x] for x in range(256)).replace(self.shown[0], "\0")  # no word holds a zero byte
        edge = np.zeros(self.t.get_vocab_size() + 1, bool)
        for token, i in self.t.get_vocab().items():
            edge[i] = token.startswith("Ġ") if lead else token.endswith("</w>")
        self.edge = edge

    def forget(self) -> None:
        self.memory = Memory(self.learn, self.most)

    @property
    def new(self) -> Pool:
        return self.memory.new

    @property
    def old(self) -> Pool:
        return self.memory.old

    def cuts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All pieces of many texts, and the number of pieces before each text and at the end. A piece begins where a text does, or with a space or line end."""
        rare = pc.match_substring_regex(texts, _ODD_SPACE).to_numpy(zero_copy_only=False)
        data, offsets = texts_buffer(texts)
        data = self.fold[data]
        edge = np.zeros(len(data) + 1, bool)
        np.equal(data, ord(" "), out=edge[:-1])
        if self.lead:
            edge[:-1] |= data == ord("\n")
            for k in np.flatnonzero(rare).tolist():
                edge[offsets[k] : offsets[k + 1]] = False
                edge[offsets[k] + np.cumsum([len(p.encode()) for p in _SAFE_CUT.split(texts[k].as_py())])[:-1]] = True
        edge[offsets] = True
        at = np.flatnonzero(edge)
        return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]), np.searchsorted(at, offsets)

    def odd(self, text: str) -> bool:
        """Whether the string of an added token may stand in the text: the library reads that as the token, so such a text is encoded whole."""
        if not self.special or self.mark[:1] not in text or self.mark not in (low := text.lower()):
            return False
        return any(x in low for x in self.special)

    def one(self, piece: str) -> bytes:
        return array("I", self.t.encode(piece, add_special_tokens=False).ids).tobytes()

    def words(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``some`` words of letters, encoded in one go, and the number of ids of each."""
        joined = "".join(some) if self.lead else " ".join(some)
        ids = np.array(self.t.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(some):  # letters that are none to the tokenizer
            return self.singly(some)
        return ids, np.diff(at, append=len(ids)) if self.lead else np.diff(at, prepend=-1)

    def by_model(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of Latin letters, which a byte-level tokenizer neither normalises nor cuts, go to its model; a line end is a word of its own."""
        model, ids, sizes = self.t.model.tokenize, array("I"), array("q")
        end = [x.id for x in model(self.shown[10])]
        for p in "\0".join(some).encode().decode("latin-1").translate(self.bytes_as).split("\0"):
            found = [x.id for x in model(p)] if p[0] == "Ġ" else end + [x.id for x in model(p[1:])]
            ids.extend(found)
            sizes.append(len(found))
        return np.array(ids, "<u4"), np.array(sizes)

    def singly(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self.one, some))
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def learn(self, some: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Different pieces in another order, all their ids and the number of ids of each."""
        is_simple = pc.match_substring_regex(pa.array(some, pa.large_string()), self.simple).to_numpy(zero_copy_only=False).tolist()
        simple, others = list(compress(some, is_simple)), [p for p, x in zip(some, is_simple, strict=True) if not x]
        alone = [p for p in others if not p.isascii() and p.startswith(self.lead) and plain(p.strip(" "))]
        rest = list(set(others).difference(alone))
        found = [(self.by_model if self.lead else self.words)(simple[at : at + _TOGETHER]) for at in range(0, len(simple), _TOGETHER)]
        found += [self.words(alone[at : at + _TOGETHER]) for at in range(0, len(alone), _TOGETHER)]
        return simple + alone + rest, *map(np.concatenate, zip(*found, self.singly(rest), strict=True))

    def flat_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, a null counting as empty, and the number of ids before each text and at the end."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = {k: self.one(t) for k in self.maybe_odd(texts) if self.odd(t := texts[k].as_py())}
        if odd:
            texts = pc.if_else(pa.array(np.isin(np.arange(len(texts)), list(odd))), "", texts)
        pieces, starts = self.cuts(texts)
        pieces = pieces.dictionary_encode()
        ids, ends = flat(self.memory.rows(*apart(pieces.dictionary)).take(pieces.indices))
        return replaced(ids, ends[starts], odd)

    def maybe_odd(self, texts: pa.Array) -> list[int]:
        return np.flatnonzero(pc.match_substring(texts, self.mark[:1]).to_numpy(zero_copy_only=False)).tolist() if self.special else []

    def ids(self, texts: list[str]) -> list[bytes]:
        ids, bounds = self.flat_ids(pa.array(texts, pa.large_string()))
        ids, bounds = memoryview(ids).cast("B"), (4 * bounds).tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def replaced(ids: np.ndarray, bounds: np.ndarray, other: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same with the ids of some texts put in place of theirs."""
    if not other:
        return ids, bounds
    found, at = [], 0
    sizes = np.diff(bounds)
    for k, own in sorted(other.items()):
        found += [ids[at : bounds[k]], np.frombuffer(own, "<u4")]
        at, sizes[k] = bounds[k + 1], len(own) // 4
    return np.concatenate([*found, ids[at:]]), np.concatenate(([0], np.cumsum(sizes)))


@lru_cache(maxsize=4)
def _encoder(path: str, lead: str) -> Encoder:
    return Encoder(path, lead)


def forget(path: str, lead: str) -> None:
    """The ids of pieces are remembered for one task: a worker that waits, or works for another stage, keeps the tokenizer alone."""
    _encoder(path, lead).forget()


def word_ids(path: str, texts: list[str]) -> list[bytes]:
    """Little-endian 32-bit ids of texts by a tokenizer that drops white space and case and marks the ends of words: those of the plain library call, in which the string of a special token is that token."""
    return _encoder(path, "").ids(texts)


def byte_ids(path: str, texts: list[str]) -> list[bytes]:
    """Little-endian 32-bit ids of texts by a byte-level tokenizer whose words take the space before them.

    A cut before a single space or line end between two other characters separates no token: a word never reaches over
    it, and what follows is read alike with or without what comes before.
    """
    return _encoder(path, " ").ids(texts)


def flat_byte_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``byte_ids`` of a column in one array, and the number of ids before each text and at the end."""
    return _encoder(path, " ").flat_ids(texts)


def batches_of(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of stretches of a string column of about ``most`` bytes: the more at once, the fewer words are looked up again, but the more memory a worker keeps for later stages."""
    _, offsets = texts_buffer(column)
    for low, high in parts(offsets, most):
        yield low, column.slice(low, high - low)
