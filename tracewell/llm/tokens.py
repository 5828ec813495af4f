"""Token ids of whole texts, put together from the ids of their distinct pieces.

A batch of texts is cut at places where the tokenizer never merges across, its pieces are
dictionary-encoded, and only distinct ones are tokenized. Merges run in tiktoken's engine, over
ranks read from the vocabulary file: as each of its tokens is what its own bytes merge to, taking
the pair whose joint token is the least merges as the file's own list of pairs does. Pieces with
characters that the two libraries might class otherwise go to the tokenizers library itself.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: Bytes of text that are tokenized at a time; longer texts are cut where pieces end.
PART_BYTES = 16_000_000

#: ASCII white space, as bytes.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~])")
#: White space beyond ASCII.
_FOREIGN_SPACE = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")
#: Pieces of texts with such: a word with the one space before it; a line break between words;
#: else all up to the next place that is plainly such an end. Python's white space holds all.
_SPACED = re.compile(r" ?\S+(?= \S|\n\S|\Z)|\n(?=\S)|(?s:.)+?(?:(?<=\S)(?= \S|\n\S)|\Z)")
#: Parts of lower-cased words of plain letters that the word tokenizer splits.
_PARTS = re.compile("'(?:[stmd]|re|ve|ll)|[^\\W\\d_\xb2\xb3\xb9\xbc\xbd\xbe]+|[\\d\xb2\xb3\xb9\xbc\xbd\xbe]|(?:[^\\w\n]|_)+")
#: The byte-level tokenizer's own pattern, with texts closed by a zero byte.
_SPLIT = r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x00]+|\s+(?![^\s\x00])|\s+"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _bounds(texts: list[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


def _array(offsets: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def words(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Runs without ASCII white space of all texts, one after the other, and each text's number."""
    bounds = _bounds(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ink = ~SPACE[data]
    some = np.diff(bounds) > 0
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    first[bounds[:-1][some]] = ink[bounds[:-1][some]]
    last[:-1] &= ~ink[1:]
    last[bounds[1:][some] - 1] = ink[bounds[1:][some] - 1]
    starts = np.flatnonzero(first)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)])
    return _array(offsets, data[ink]), np.diff(np.searchsorted(starts, bounds))


def spaced_pieces(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Pieces, white space included, across which byte-level merges never go: words with the one
    space before them, and other white space. Texts hold no white space beyond ASCII."""
    bounds = _bounds(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    space = SPACE[data]
    some = np.diff(bounds) > 0
    after = np.append(space[1:], True)
    after[bounds[1:][some] - 1] = True  # nothing follows a text's last byte
    first = space.copy()
    first[1:] &= ~(space[:-1] & after[1:])
    first[1:] |= ~space[1:] & space[:-1] & (data[:-1] != 32)
    first[bounds[:-1][some]] = True
    starts = np.flatnonzero(first)
    return _array(np.append(starts, len(data)), data), np.diff(np.searchsorted(starts, bounds))


def _closed(pieces: pa.LargeBinaryArray, end: bytes) -> str:
    """All pieces in one text, each with an end after it."""
    if not len(pieces):
        return ""
    return (pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces.cast(pa.binary())), end)[0].as_py() + end).decode()


def _byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: printable ones stand for
    themselves, the others follow from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def ranks(path: str) -> dict[bytes, int]:
    """Ids of a file's tokens by their bytes; a word's end is written as a zero byte. A file whose
    merges do not come in the order of their tokens' ids is refused."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
        raise ValueError("not a byte-level merge vocabulary")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a.removesuffix(model.get("end_of_word_suffix") or "\n") + b] for a, b in pairs]
    if made != sorted(set(made)):
        raise ValueError("merges are not in the order of ids")
    byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
    end, out = model.get("end_of_word_suffix") or "", {}
    for token, i in model["vocab"].items():
        body = token.removesuffix(end) if end else token
        if all(c in byte_of for c in body) and not token.startswith("<|"):
            out[bytes(byte_of[c] for c in body) + (b"\0" if body != token else b"")] = i
    return out


class Encoder:
    """Encodes UTF-8 texts by one tokenizer, without special tokens added, truncation or padding."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.drops_space = "Split" in str(self.tokenizer.pre_tokenizer)
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")
        table = ranks(path)
        pattern = r"[^\x00\n]+\x00|\n" if self.drops_space else _SPLIT
        self.engine = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.closing = table[b"\n" if self.drops_space else b"\0"]

    def _odd(self, pieces: pa.LargeBinaryArray) -> np.ndarray:
        """Which pieces the library itself must encode."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        odd = data == 0
        if self.drops_space:
            # From U+0240 on, white space, the dotted I, and what may begin a special token.
            odd |= data >= 0xC9
            before, now = data[:-1], data[1:]
            odd[1:] |= (before == 0xC2) & ((now == 0x85) | (now == 0xA0)) | (before == 0xC4) & (now == 0xB0) | (before == 0x3C) & (now == 0x7C)
        else:
            # From U+10000 on, where tables of letters differ most.
            odd |= data >= 0xF0
        return np.logical_or.reduceat(odd, offsets[:-1] - offsets[0])

    def pieces_ids(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (none of them empty), one after the other, and where each begins and ends."""
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        odd = self._odd(pieces)
        text = _closed(pieces.filter(pa.array(~odd)) if odd.any() else pieces, b"\n" if self.drops_space else b"\0")
        if self.drops_space:
            text = _PARTS.sub("\\g<0>\0", text.lower())
        found = self.engine.encode_to_numpy(text) if text else np.zeros(0, np.uint32)
        closes = found == self.closing
        sizes = np.zeros(len(pieces), np.int64)
        sizes[~odd] = np.diff(np.flatnonzero(closes), prepend=-1) - 1
        found = found[~closes]
        at = np.flatnonzero(odd)
        if len(at):
            texts = [x.decode() for x in pieces.take(pa.array(at)).to_pylist()]
            own = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes[at] = list(map(len, own))
            ends = np.cumsum(sizes)
            ids = np.empty(int(ends[-1]), np.uint32)
            mine = np.repeat(odd, sizes)
            ids[~mine] = found
            ids[mine] = [i for e in own for i in e]
            found = ids
        return found, np.concatenate([[0], np.cumsum(sizes)])

    def counts(self, pieces: pa.LargeBinaryArray) -> np.ndarray:
        """Numbers of tokens of pieces."""
        return np.diff(self.pieces_ids(pieces)[1])

    def _regular(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts, by numpy and Arrow throughout."""
        pieces, number = words(texts) if self.drops_space else spaced_pieces(texts)
        return self._joined(pieces, number)

    def _joined(self, pieces: pa.LargeBinaryArray, number: np.ndarray) -> list[bytes]:
        coded = pieces.dictionary_encode()
        ids, bounds = self.pieces_ids(coded.dictionary)
        listed = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(ids)).take(coded.indices)
        ends = np.frombuffer(listed.buffers()[1], np.int64)[: len(listed) + 1]
        at = ends[np.concatenate([[0], np.cumsum(number)])].tolist()
        flat = listed.flatten().to_numpy()
        return [flat[a:b].tobytes() for a, b in zip(at, at[1:])]

    def _irregular(self, text: bytes) -> bytes:
        """Ids of a text with white space beyond ASCII or special tokens, where white space counts."""
        if self.special.search(text):
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        pieces = [x.encode() for x in _SPACED.findall(text.decode())]
        return self._joined(_array(_bounds(pieces), np.frombuffer(b"".join(pieces), np.uint8)), np.array([len(pieces)]))[0]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, owners, size = [], [], 0
        for i, text in enumerate(texts):
            for part in _cut(text):
                plain = self.drops_space or b"<|" not in part and (part.isascii() or not _FOREIGN_SPACE.search(part))
                waiting.append((part, plain))
                owners.append((i, len(out[i])))
                out[i].append(b"")
                size += len(part)
                if size >= PART_BYTES:
                    self._flush(waiting, owners, out)
                    waiting, owners, size = [], [], 0
        self._flush(waiting, owners, out)
        return [parts[0] if len(parts) == 1 else b"".join(parts) for parts in out]

    def _flush(self, waiting, owners, out) -> None:
        regular = iter(self._regular([part for part, plain in waiting if plain]))
        for (part, plain), (i, k) in zip(waiting, owners, strict=True):
            out[i][k] = next(regular) if plain else self._irregular(part)


def _cut(text: bytes):
    """A text, or parts of a long one, each ending where a piece does."""
    start = 0
    while len(text) - start > PART_BYTES and (m := _CUT.search(text, start + PART_BYTES)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own encoder."""
    return Encoder(path)
