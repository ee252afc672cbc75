"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece of text the last token of that prefix's encoding is unique: the one token that ends there and
stays apart from the last token of what is before it when the two are encoded together. `PrefixBpe.extend` keeps that
token for each prefix, so a piece can grow at its end without being encoded anew, and the ids are read backwards from it.
`EncodedText` keeps whole texts that way: appends and edits encode only the chunks around them.

Whole texts are cut into chunks that don't depend on their neighbours (`chunks`); only chunks that a worker hasn't met are
encoded, and ids are gathered, and decoded, a piece of about 256 KB at a time. Ids of a piece that don't decode to its bytes
(hashes of chunks that clash) are made anew without the kept ones.

Rows: a null text counts as empty (no ids; digests of the empty string). Texts of any length are read in pieces of about
256 KB cut before a lone space, which never changes the ids; a longer piece without one is encoded as a whole, in time in
proportion to its length. Repeated rows give repeated results; an empty table gives none;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .arrays import buffer_of, release
from .chunks import ChunkIds, gathered
from .common import slices, small_batches

#: White space as Unicode has it; Python's \s also takes the four separators from x1c to x1f.
SPACE, OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
CHUNK = re.compile(rf" ?{OTHER}+|{SPACE}+(?!{OTHER})|{SPACE}+")
SAFE = re.compile(rf"(?<={OTHER}) (?={OTHER})")
LONG = PIECE = 1 << 18
#: Chunks kept by a worker (some 30 bytes each), and a tenth as many prefixes and pairs; only speed depends on it.
CHUNKS = 2_000_000


def parts(text: str, most: int = LONG) -> Iterator[str]:
    """The text in pieces of about `most` characters; no chunk spans two of them."""
    at = 0
    while len(text) - at > most:
        cut = SAFE.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, chunks: int = CHUNKS):
        self.ranks, self.most = ranks, chunks
        #: The longest token by its last three bytes; those of one or two bytes aren't in it.
        self.longest: dict[bytes, int] = {}
        for raw in ranks:
            if len(raw) > 2:
                self.longest[raw[-3:]] = max(self.longest.get(raw[-3:], 0), len(raw))
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern)
        #: The last merge that makes each token of several bytes, and the token that each such pair makes.
        self.split_of: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for raw, token in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(raw)):
                left, right = ranks.get(raw[:i], token), ranks.get(raw[i:], token)
                if left < token and right < token and self.stays_apart(left, right):
                    self.split_of[token] = left, right
                    self.joined[left, right] = token
                    break
        #: Of byte prefixes seen lately, the last tokens up to there; and of pairs, whether they stay apart.
        self.prefixes: dict[bytes, list[int]] = {}
        self.apart: dict[int, bool] = {}
        me = weakref.proxy(self)  # a cycle would keep all of this beyond its last use, beside the next one
        self.known = ChunkIds(lambda new: me._learnt(new), chunks)
        #: Bytes of all tokens, and a space and the digits of all ids, end to end, with starts and lengths by id.
        n = max(self.bytes_of, default=-1) + 1
        self.raw = _laid([self.bytes_of.get(i, b"") for i in range(n)])
        self.digits = _laid([b" %d" % i for i in range(n)])

    @classmethod
    def load(cls, name: str, chunks: int = CHUNKS) -> PrefixBpe:
        with open(public_tokenizers.path(name) if "/" not in name else name, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, chunks=chunks)

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of both gives a, b: undoes the latest merge on either side of the cut, again and again, and looks for an earlier merge across it."""
        joined, split, limit = self.joined.get, self.split_of.get, 1 << 60
        while True:
            across = joined((a, b))
            if across is not None and across < limit:
                return False
            left, right = split(a), split(b)
            if left and (not right or a > b):
                limit, a = a, left[1]
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True

    def extend(self, piece: bytes, last: list[int], start: int = 0) -> list[int]:
        """last[i]: the last token of piece[: i + 1]; appends those from `start` on, which must be len(last)."""
        get, reach, stored, known = self.ranks.get, self.longest.get, self.prefixes, self.apart
        if len(stored) > self.most // 10:
            stored.clear()
        if len(known) > self.most // 10:
            known.clear()
        if not start:  # what is kept has each of its prefixes too, so the longest one is found by halving
            low, high = 0, min(len(piece), 63)
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if piece[:middle] in stored else (low, middle - 1)
            if low:
                start = low
                last += stored[piece[:low]][:low]
        for end in range(start + 1, len(piece) + 1):
            low = max(0, end - reach(piece[max(0, end - 3) : end], 2))
            tail = piece[low:end]  # no longer than a token, so a piece takes time in proportion to its length
            for begin in range(low, end):
                token = get(tail[begin - low :])
                if token is not None:
                    if not begin:
                        if self.whole(tail, token):
                            break
                        continue
                    pair = last[begin - 1] << 20 | token
                    apart = known.get(pair)
                    if apart is None:
                        apart = known[pair] = self.stays_apart(last[begin - 1], token)
                    if apart:
                        break
            else:
                raise ValueError(f"no token ends at byte {end} of {piece[:50]!r}")
            last.append(token)
        head = last if len(piece) < 64 else last[:63]
        for end in range(start + 1, min(len(piece), 63) + 1):
            stored[piece[:end]] = head
        return last

    def whole(self, piece: bytes, token: int) -> bool:
        """Whether these bytes, which are a token, are encoded as it by merges."""
        return len(piece) == 1 or token in self.split_of

    def read_back(self, piece: bytes, last: list[int]) -> list[int]:
        if (token := self.ranks.get(piece)) is not None:
            return [token]  # a piece that is a token is that token, even if no merges lead to it
        ids, end = [], len(piece)
        while end:
            ids.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return ids[::-1]

    def encode_chunk(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for piece in [chunk] if chunk.lstrip(" ").isalpha() and chunk[:2] != "  " else self.split.findall(chunk):
            raw = piece.encode()
            token = self.ranks.get(raw)
            ids += [token] if token is not None else self.read_back(raw, self.extend(raw, []))
        return ids

    def _learnt(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.encode_chunk(c.decode()) for c in chunks]
        return np.array([len(x) for x in found]), np.array([i for x in found for i in x], dtype=np.uint32)

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and where those of each begin."""
        buf, offsets = buffer_of(texts)
        ids, upto = self.known.ids(buf, offsets)
        raw, _ = gathered(*self.raw, ids)
        if len(raw) == len(buf) and (raw == buf).all():
            return ids, upto
        lists = [self.encode(x.as_py() or "") for x in texts]
        return np.array([i for x in lists for i in x], dtype=np.uint32), np.cumsum([0, *map(len, lists)])

    def encode(self, text: str) -> list[int]:
        return [i for part in parts(text) for c in CHUNK.findall(part) for i in self.encode_chunk(c)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _laid(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(v) for v in values], dtype=np.int64)
    return np.frombuffer(b"".join(values), dtype=np.uint8), np.cumsum(length) - length, length


class EncodedText:
    """A text with its ids by chunk. append() and edit() give exactly what encoding the new text would, from the chunks around the change."""

    def __init__(self, bpe: PrefixBpe, text: str = ""):
        self.bpe, self.chunks, self.ids_of = bpe, [], []
        self.tail: tuple[bytes, list[int]] = (b"", [])  # the last piece and its prefixes' last tokens
        self._put(0, 0, text)

    def _put(self, i: int, j: int, text: str) -> None:
        new = CHUNK.findall(text)
        self.chunks[i:j] = new
        self.ids_of[i:j] = [self._encode(c) if i + k == len(self.chunks) - 1 else self.bpe.encode_chunk(c) for k, c in enumerate(new)]

    def _encode(self, chunk: str) -> list[int]:
        """The last chunk; goes on from the kept prefixes where its last piece only grew."""
        *head, piece = self.bpe.split.findall(chunk)
        raw, (before, last) = piece.encode(), self.tail
        if not (before and raw.startswith(before)):
            last = []
        self.tail = raw, self.bpe.extend(raw, list(last), len(last))
        return [i for p in head for i in self.bpe.encode_chunk(p)] + self.bpe.read_back(*self.tail)

    def append(self, text: str) -> None:
        keep = len(self.chunks)
        while keep and self.chunks[keep - 1].isspace():
            keep -= 1
        keep = max(0, keep - 1)
        self._put(keep, len(self.chunks), "".join(self.chunks[keep:]) + text)

    def edit(self, start: int, end: int, text: str) -> None:
        """Replaces the characters from start to end."""
        at, bounds = 0, []
        for c in self.chunks:
            bounds.append(at)
            at += len(c)
        i = max(0, sum(b <= start for b in bounds) - 1)
        while i and (self.chunks[i - 1].isspace() or bounds[i] >= start):
            i -= 1
        j = next((k for k in range(i + 1, len(self.chunks)) if bounds[k] > end and bounds[k - 1] >= end and SAFE.match("x" + self.chunks[k], 1) and not self.chunks[k - 1][-1].isspace()), len(self.chunks))
        left = bounds[i] if self.chunks else 0
        right = bounds[j] if j < len(self.chunks) else at
        old = "".join(self.chunks[i:j])
        self._put(i, j, old[: start - left] + text + old[end - left : right - left])

    def ids(self) -> list[int]:
        return [i for ids in self.ids_of for i in ids]


_loaded: dict[tuple[str, int], PrefixBpe] = {}


def loaded(name: str, chunks: int = CHUNKS) -> PrefixBpe:
    """One for each worker, with up to so many chunks kept between texts."""
    if (name, chunks) not in _loaded:
        _loaded[name, chunks] = PrefixBpe.load(name, chunks)
    return _loaded[name, chunks]


def encoded(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False, chunks: int = CHUNKS) -> DataFrame:
    """The kept columns, n_tokens, ids_sha256 (of decimal ids joined by one space) and decoded_sha256 (of the decoded bytes); with ids=True also the ids."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep)
    out = kept.schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        out = out.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary, chunks)
        for batch in batches:
            for piece in slices(batch, len(keep), PIECE):
                texts = piece.column(len(keep))
                if piece.num_rows == 1 and len(texts[0].as_py() or "") > LONG:
                    found = map(pa.array, ([p] for p in parts(texts[0].as_py())))
                else:
                    found = [texts]
                a, b = ([hashlib.sha256() for _ in range(piece.num_rows)] for _ in range(2))
                n, flat = np.zeros(piece.num_rows, dtype=np.int64), []
                for some in found:  # the rows, or one after another the parts of a single long row
                    given, upto = bpe.ids_of(some)
                    for digests, laid, skip in ((a, bpe.digits, 1), (b, bpe.raw, 0)):
                        data, at = gathered(*laid, given)
                        cuts, view = at[upto].tolist(), memoryview(data)
                        for i, digest in enumerate(digests):
                            digest.update(view[cuts[i] + (skip if not n[i] and cuts[i + 1] > cuts[i] else 0) : cuts[i + 1]])
                    n += np.diff(upto)
                    if ids:
                        flat.append(given.astype(np.int32))
                columns = [piece.column(i) for i in range(len(keep))] + [pa.array(n), pa.array([x.hexdigest() for x in a], pa.string()), pa.array([x.hexdigest() for x in b], pa.string())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(flat))))
                yield pa.RecordBatch.from_arrays(columns, names=out.names)
        if chunks < CHUNKS:  # a worker that has other things to do keeps nothing
            _loaded.pop((vocabulary, chunks), None)
            del bpe
            release()

    return docs.select(*keep, text).mapInArrow(run, out)


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
