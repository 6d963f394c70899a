"""Token ids of whole texts, word by word: what a tokenizer makes of a text is the chain of what it makes of its words.

Words repeat, texts don't.  The words of a slab of texts are found at once from the classes of its
bytes, each different word is tokenized once, and a worker keeps the ids of words that repeat, in a
table bounded by bytes.  A piece with characters beyond the extended Latin blocks, and a text whose
spaces could influence their neighbours, goes whole to the tokenizer itself.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of remembered words and their ids at most; a word of more bytes than LONG is never remembered.
TABLE_BYTES, LONG = 32 << 20, 64
#: Code points below this are told apart by tables; their classes are letter, number, space, other.
_SIMPLE = 0x250
_LETTER, _NUMBER, _SPACE, _OTHER, _SLOW = range(5)
_SPACES = {*range(9, 14), 0x20, 0x85, 0xA0}
#: White space from _SIMPLE on, with white space beside it.
_WIDE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_GAPS = rf"[{_WIDE}][\t-\r \x{{85}}\x{{a0}}{_WIDE}]|[\t-\r \x{{85}}\x{{a0}}][{_WIDE}]"


def _class_of(point: int) -> int:
    if point in _SPACES:
        return _SPACE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(point))[0], _OTHER)


_CLASS = np.array([_class_of(p) for p in range(_SIMPLE)], np.uint8)
_LOWER = np.array([ord(c) if len(c := chr(p).lower()) == 1 else p for p in range(_SIMPLE)], np.uint16)
_CLASS[[p for p in range(_SIMPLE) if len(chr(p).lower()) != 1 or _LOWER[p] > 0x7FF]] = _SLOW
_BYTE_CLASS = np.concatenate([_CLASS[:128], np.full(128, _SLOW, np.uint8)])
_BYTE_LOWER = np.concatenate([_LOWER[:128].astype(np.uint8), np.arange(128, 256, dtype=np.uint8)])


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it prints, else as the next letter from U+0100."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in printing else chr(next(rest)) for b in range(256)}


LETTERS = _byte_letters()


def words_of(data: np.ndarray, begins: np.ndarray, spaced: bool, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin in the UTF-8 data of texts that begin at `begins`, their classes, and the data, lower-cased if not `spaced`.

    spaced: a space belongs to the word after it, and white space makes words of its own; else white
    space is dropped by the caller, numbers are single, and letters are lower-cased.  `whole` marks
    texts that stay one word.  The words are those of the split patterns of the two vocabularies.
    """
    n = len(data)
    kind = _BYTE_CLASS[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    lower = data if spaced else _BYTE_LOWER[data]
    if len(lead):
        points = ((data[lead] & 0x1F).astype(np.uint16) << 6) | (data[lead + 1] & 0x3F)
        lead, points = lead[points < _SIMPLE], points[points < _SIMPLE]
        kind[lead] = kind[lead + 1] = _CLASS[points]
        if not spaced:
            known = _CLASS[points] != _SLOW
            small, at = _LOWER[points[known]], lead[known]
            lower[at], lower[at + 1] = 0xC0 | (small >> 6), 0x80 | (small & 0x3F)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    cut = np.zeros(n + 4, bool)  # beyond the end: no word begins there
    cut[: n + 1] = first
    cut[1:n] |= kind[1:] != kind[:-1]
    if spaced:  # of a run of white space before a word, the last one stands alone, or with the word if it is a space
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:n])
        one = last - ((data[last] & 0xC0) == 0x80)
        cut[one] = True
        cut[last[data[last] == 0x20] + 1] = False
    else:
        cut[:n] |= (kind == _NUMBER) & ((data & 0xC0) != 0x80)
    # 's 't 'm 'd 're 've 'll: an apostrophe that begins a word, right before such letters, takes them
    mark = np.flatnonzero((lower[: max(n - 1, 0)] == 0x27) & cut[: max(n - 1, 0)])
    mark = mark[(kind[mark + 1] == _LETTER) & ~first[mark + 1]]
    if len(mark):
        a, b = lower[mark + 1], np.where(mark + 2 < n, lower[np.minimum(mark + 2, n - 1)], 0)
        b[first[np.minimum(mark + 2, n)]] = 0
        size = np.where(np.isin(a, np.frombuffer(b"stmd", np.uint8)), 2, 0)
        size[((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)] = 3
        mark, size = mark[size > 0], size[size > 0]
        cut[mark + 1] = False
        cut[mark + size] = True
    slow = kind == _SLOW
    if slow.any() or len(whole):  # pieces between white space stay as they are
        ends = first[:n].copy()
        ends[1:] |= cut[1:n] & ((kind[1:] == _SPACE) | (kind[:-1] == _SPACE))
        piece = np.cumsum(ends) - 1
        bad = np.zeros(int(piece[-1]) + 1 if n else 0, bool)
        bad[piece[slow]] = True
        inside = bad[piece]
        cut[:n] &= ~inside | ends
        bounds = np.append(begins, n)
        for k in whole.tolist():
            inside[bounds[k] : bounds[k + 1]] = True
            cut[bounds[k] + 1 : bounds[k + 1]] = False
        if not spaced:
            lower[inside] = data[inside]
        kind[inside] = _SLOW
    starts = np.flatnonzero(cut[:n])
    return starts, kind[starts], lower


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text's ids."""
    return np.insert(ids, ends[1:], np.uint32(end_id)), ends + np.arange(len(ends))


def _binary(parts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An array of values that lie one after another."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(parts))])


def _nothing() -> pa.Array:
    return pa.array([], pa.binary())


class WordTable:
    """encode(texts): the ids of all texts in one array, and where each text's begin and end."""

    #: Whether a space belongs to the word after it, as in words_of.
    spaced = True
    #: Strings in a text that the tokenizer doesn't take as text.
    special: tuple[str, ...] = ()

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.words, self.ids = _nothing(), _nothing()

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has."""
        raise NotImplementedError

    def encode_whole(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def whole_texts(self, texts: pa.Array) -> np.ndarray:
        marked = [pc.match_substring(texts, s) for s in self.special]
        if self.spaced and not pc.all(pc.string_is_ascii(texts)).as_py():
            marked.append(pc.match_substring_regex(texts, _GAPS))
        return np.flatnonzero(reduce(pc.or_, marked).to_numpy(zero_copy_only=False)) if marked else np.zeros(0, np.int64)

    def learnt(self, words: pa.Array, slow: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The ids of different words: an array of values, and each word's place in it.  The table keeps them until it is full, then those of this call."""
        place = pc.index_in(words, value_set=self.words)
        missing = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        place = place.fill_null(0).to_numpy().astype(np.int64)
        plain, odd = missing[~slow[missing]], missing[slow[missing]]
        flat, counts = self.encode_words(words.take(pa.array(plain)).to_pylist())
        parts = [self.encode_whole(w.decode()) for w in words.take(pa.array(odd)).to_pylist()]
        counts = np.concatenate([counts, np.array([len(p) for p in parts], np.int64)])
        new = _binary(np.concatenate([flat, *parts]).astype("<u4"), 4 * counts)
        order = np.concatenate([plain, odd])
        place[order] = len(self.ids) + np.arange(len(order))
        values = pa.concat_arrays([self.ids, new])
        short = pc.less_equal(pc.binary_length(fresh := words.take(pa.array(order))), LONG)
        if values.nbytes + self.words.nbytes + fresh.nbytes <= TABLE_BYTES:
            self.words, self.ids = pa.concat_arrays([self.words, fresh.filter(short)]), pa.concat_arrays([self.ids, new.filter(short)])
        else:
            short = pc.less_equal(pc.binary_length(words), LONG)
            self.words, self.ids = words.filter(short), values.take(pa.array(place)).filter(short)
            if self.words.nbytes + self.ids.nbytes > TABLE_BYTES // 2:
                self.forget()
        return values, place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        bounds = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        some = np.flatnonzero(bounds[1:] > bounds[:-1])
        starts, kinds, data = words_of(data, bounds[some], self.spaced, np.searchsorted(some, self.whole_texts(texts))) if len(some) else (np.zeros(0, np.int64), np.zeros(0, np.uint8), data)
        words = _binary(data, np.diff(np.append(starts, len(data))))
        if not self.spaced:
            kept = kinds != _SPACE
            words, starts, kinds = words.filter(pa.array(kept)), starts[kept], kinds[kept]
        if not len(words):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        coded = words.dictionary_encode()
        codes, slow = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), bool)
        slow[codes[kinds == _SLOW]] = True
        values, place = self.learnt(coded.dictionary, slow)
        sizes = np.diff(np.frombuffer(values.buffers()[1], np.int32, len(values) + 1))[place][codes]
        if int(sizes.sum(dtype=np.int64)) >= 1 << 31:
            values = values.cast(pa.large_binary())
        chained = values.take(pa.array(place[codes]))
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        return np.frombuffer(chained.buffers()[2] or b"", "<u4", int(ends[-1]) // 4), ends[np.searchsorted(starts, bounds)] // 4


class LibraryWords(WordTable):
    """The tokenizers library over a vocabulary file, with add_special_tokens=False and otherwise as the file says.

    literal: strings of special tokens in a text are ordinary text; else, as is the library's
    default, they give the special token's id.
    """

    def __init__(self, path: str, words: bool, literal: bool = False):
        super().__init__()
        from tokenizers import Tokenizer

        self.spaced = not words
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = () if literal else tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def encode_words(self, words):
        merge = self.tokenizer.model.tokenize
        text = b"\xff".join(words).decode("latin-1").translate(LETTERS)  # no UTF-8 holds a byte 255, and its letter is its own
        found = [[x.id for x in merge(w)] for w in text.split("\xff")] if words else []
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode_whole(self, text):
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


_ENCODERS: dict = {}


def library(path: str, words: bool, literal: bool = False) -> LibraryWords:
    """One encoder for each vocabulary and worker process; it outlives tasks, its table is bounded."""
    key = (path, words, literal)
    if key not in _ENCODERS:
        _ENCODERS[key] = LibraryWords(path, words, literal)
    return _ENCODERS[key]
