"""Encoding into SentencePiece pieces, in batches of words of one length, and decoding.

Unigram models are searched by Viterbi. A BPE model's ids are what its merges
leave, which no sum of piece scores reproduces; for those the same table of
substrings found among the sorted piece keys drives the merges instead.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periscan.llm.arrow import map_texts

#: The character that stands for a space in pieces.
SPACE = "▁"
#: An unknown character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words kept in a worker, cells of a search table, and the longest word that is kept.
KEPT_WORDS, TABLE_CELLS, KEPT_LENGTH = 300_000, 1_000_000, 64
#: Characters of a text that are cut into words at a time, and words that are looked up at a time: a word takes some 70 bytes.
PART_CHARS, PART_WORDS = 1 << 18, 1 << 16
#: Longer words are merged one at a time: in the batched search every merge looks at the whole word.
LONG_WORD = 512
FILTER_MASK = np.uint64((1 << 20) - 1)
#: Model type in a model file: field 2 of it, field 3 of that.
BPE = 2


def _model_type(proto: bytes) -> int:
    def fields(data: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                c = data[at]
                at, out, shift = at + 1, out | (c & 127) << shift, shift + 7
                if c < 128:
                    return out

        while at < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                n = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
                yield key >> 3, data[at : at + n]
                at += n

    return next((kind for k, spec in fields(proto) if k == 2 for f, kind in fields(spec) if f == 3), 1)


_coders: dict[str, PieceCoder] = {}


class PieceCoder:
    """Pieces and scores of a model file, and the ids of words already seen."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_at = {}
        texts, scores, ids, self.table = [], [], [], []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_at[int(piece[3:-1], 16)] = i
                self.table.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.table.append(b"")
            else:
                texts.append(piece)
                scores.append(sp.get_score(i))
                ids.append(i)
                self.table.append(piece.encode())
        self.longest = max(map(len, texts))
        keys = np.array([self._key(t) for t in texts], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids, np.int64)[order]
        self.scores = np.array(scores)[order]
        self.of = dict(zip(texts, zip(scores, ids, strict=True), strict=True))
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.unknown = self.scores.min() - UNKNOWN_PENALTY
        self.filter = np.zeros(int(FILTER_MASK) + 1, bool)  # spares most substrings the search among the keys
        self.filter[(self.keys & FILTER_MASK).astype(np.int64)] = True
        #: What the model's own library does: a Viterbi search for unigram models, merges for BPE models.
        self.method = "merges" if _model_type(sp.serialized_model_proto()) == BPE else "viterbi"
        self.kept: dict[str, dict[str, bytes]] = {"viterbi": {}, "merges": {}}

    def _key(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def table_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece that ends at each place with each length, for words of one length.

        Both have the axes (end, longest less length, word); -inf and -1 where there is no piece.
        """
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length).T.astype(np.uint64) + np.uint64(1)
        widest = min(self.longest, length)
        value = np.full((length, widest, n), -np.inf)
        which = np.full((length, widest, n), -1, np.int64)
        rolled = np.zeros((length, n), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, widest + 1):
                rolled = (rolled[: length - k + 1] if k > 1 else rolled) * BASE + codes[k - 1 :]
                maybe = np.nonzero(self.filter[(rolled & FILTER_MASK).astype(np.int64)])
                key = rolled[maybe]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                end, word, at = maybe[0][hit] + (k - 1), maybe[1][hit], at[hit]
                value[end, widest - k, word] = self.scores[at]
                which[end, widest - k, word] = self.ids[at]
        return value, which

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of the best-scored cut of words of one length: the table is filled one end at a time for all words together.

        Ties go to the longer last piece. A character that is no piece is
        unknown, and becomes the pieces of its UTF-8 bytes.
        """
        n, length = len(words), len(words[0])
        value, which = self.table_of(words)
        widest = value.shape[1]
        single = value[:, widest - 1]
        single[np.isneginf(single)] = self.unknown
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((length, n), np.int64)
        for end in range(length):
            m = min(widest, end + 1)
            total = best[end + 1 - m : end + 1] + value[end, widest - m :]
            pick = total.argmax(0)
            best[end + 1] = np.take_along_axis(total, pick[None], 0)[0]
            back[end] = m - pick
        begins = np.zeros((length, n), np.int64)  # the end of the piece that begins here; 0: none does
        at, every = np.full(n, length), np.arange(n)
        while len(every):  # walk back through all words at once
            start = at[every] - back[at[every] - 1, every]
            begins[start, every] = at[every]
            at[every] = start
            every = every[start > 0]
        return self._ids(words, begins, which)

    def merges(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length by merging, in every word at once, the best-scored pair of neighbours (the first of equals) until none is a piece."""
        n, length = len(words), len(words[0])
        value, which = self.table_of(words)
        widest = value.shape[1]

        def score(start: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
            ok = end - start <= widest
            return np.where(ok, value[end - 1, np.where(ok, widest - (end - start), 0), word], -np.inf)

        every = np.arange(n)
        after = np.repeat(np.arange(1, length + 1)[:, None], n, 1)  # the end of the piece that begins here
        before = np.repeat(np.arange(-1, length - 1)[:, None], n, 1)  # the start of the piece before
        pair = np.full((length, n), -np.inf)
        for k in range(length - 1):
            pair[k] = value[k + 1, widest - 2]
        begins = np.ones((length, n), bool)
        live = every
        while len(live):
            at = pair[:, live].argmax(0)
            more = ~np.isneginf(pair[at, live])
            live, at = live[more], at[more]
            if not len(live):
                break
            middle = after[at, live]
            end = after[middle, live]
            after[at, live] = end
            begins[middle, live] = False
            pair[middle, live] = -np.inf
            inner = end < length
            w, s, e = live[inner], at[inner], end[inner]
            before[e, w] = s
            pair[at, live] = -np.inf
            pair[s, w] = score(s, after[e, w], w)
            first = at > 0
            w, e = live[first], end[first]
            s = before[at[first], w]
            pair[s, w] = score(s, e, w)
        return self._ids(words, np.where(begins, after, 0), which)

    def stretches(self, word: str) -> Iterator[str]:
        """A word cut wherever no piece crosses, so that no merge does either."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
        edges = np.zeros(len(codes) + 1, np.int32)
        with np.errstate(over="ignore"):
            for begin in range(0, len(codes), PART_WORDS):
                part = codes[begin : begin + PART_WORDS + self.longest - 1].astype(np.uint64) + np.uint64(1)
                rolled = np.zeros(len(part), np.uint64)
                for k in range(1, min(self.longest, len(part)) + 1):
                    rolled = rolled[: len(part) - k + 1] * BASE + part[k - 1 :]
                    maybe = np.nonzero(self.filter[(rolled & FILTER_MASK).astype(np.int64)])[0]
                    at = np.minimum(np.searchsorted(self.keys, rolled[maybe]), len(self.keys) - 1)
                    start = begin + maybe[self.keys[at] == rolled[maybe]]
                    edges[start + 1] += 1
                    edges[start + k] -= 1
        start = 0
        for end in np.nonzero(np.cumsum(edges)[1:] == 0)[0] + 1:
            yield word[start:end]
            start = end

    def merge_long(self, word: str) -> bytes:
        """What :meth:`merges` gives for one word, of any length: the next pair comes from a heap. Takes some 300 bytes for each character of the longest stretch."""
        out = bytearray()
        for part in self.stretches(word):
            n = len(part)
            after = list(range(1, n + 1))  # 0: nothing begins here any more
            before = list(range(-1, n))
            pairs: list[tuple[float, int, int, int]] = []

            def offer(start: int) -> None:
                if start >= 0 and after[start] < n:
                    end = after[after[start]]
                    if (got := self.of.get(part[start:end])) is not None:
                        heapq.heappush(pairs, (-got[0], start, after[start], end))

            for k in range(n - 1):
                offer(k)
            while pairs:
                _, start, middle, end = heapq.heappop(pairs)
                if after[start] == middle and after[middle] == end:
                    after[start], after[middle], before[end] = end, 0, start
                    offer(before[start])
                    offer(start)
            start = 0
            while start < n:
                piece = part[start : after[start]]
                ids = [self.of[piece][1]] if piece in self.of else [self.bytes_at[b] for b in piece.encode("utf-8", "replace")]
                out += np.array(ids, "<u4").tobytes()
                start = after[start]
        return bytes(out)

    def _ids(self, words: list[str], ends: np.ndarray, which: np.ndarray) -> list[bytes]:
        """Ids of the pieces; ``ends`` has the end of each piece at the place where it begins, else 0."""
        widest = which.shape[1]
        word, start = np.nonzero(ends.T)
        end = ends[start, word]
        ids = which[end - 1, widest - (end - start), word]
        if (ids < 0).any():
            parts = [[i] if i >= 0 else [self.bytes_at[b] for b in words[w][k].encode("utf-8", "replace")] for i, w, k in zip(ids.tolist(), word.tolist(), start.tolist(), strict=True)]
            word = np.repeat(word, [len(x) for x in parts])
            ids = np.array([i for x in parts for i in x])
        flat = ids.astype("<u4").tobytes()
        bounds = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words))) * 4)).tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    def words(self, text: str) -> list[str]:
        """The stretches that no piece crosses: blanks with what follows them, and newlines."""
        if "  " in text or SPACE in text or "\0" in text:
            return re.findall(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+", text.replace(" ", SPACE))
        return [w for w in text.replace(" ", "\0" + SPACE).replace("\n", "\0\n\0").split("\0") if w]

    def parts(self, text: str) -> Iterator[list[str]]:
        """The words of a text after a space, as the model's normaliser puts it, by parts of about ``PART_CHARS`` characters; a part ends where a run of blanks begins, so that no word is cut."""
        start, text = 0, " " + text
        while len(text) - start > PART_CHARS:
            at = text.find(" ", start + PART_CHARS)
            while at > 0 and text[at - 1] in (" ", SPACE):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield self.words(text[start:at])
            start = at
        yield self.words(text[start:])

    def encode(self, texts: list[str | None], method: str | None = None) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; none for null and empty texts. ``method``: the model's own if None."""
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, list[str]]] = []
        held = 0

        def empty() -> None:
            for (k, _), ids in zip(group, self._encode_words([cut for _, cut in group], method or self.method), strict=True):
                out[k].append(ids)
            group.clear()

        for k, t in enumerate(texts):
            for cut in self.parts(t) if t else ():
                group.append((k, cut))
                held += len(cut)
                if held >= PART_WORDS:
                    empty()
                    held = 0
        empty()
        return [b"".join(x) for x in out]

    def _encode_words(self, cuts: list[list[str]], method: str) -> list[bytes]:
        kept, search = self.kept[method], getattr(self, method)
        get = kept.get
        out: list[bytes | None] = []
        open_cuts: list[tuple[int, list[str]]] = []
        new: set[str] = set()
        for k, cut in enumerate(cuts):
            got = list(map(get, cut))
            if None in got:
                out.append(None)
                open_cuts.append((k, cut))
                new.update(w for w, g in zip(cut, got, strict=True) if g is None)
            else:
                out.append(b"".join(got))
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
            new = set().union(*(cut for _, cut in open_cuts))
        by_length: dict[int, list[str]] = {}
        for w in new:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            if method == "merges" and length > LONG_WORD:
                kept.update((w, self.merge_long(w)) for w in group)
                continue
            step = max(1, TABLE_CELLS // (length * min(self.longest, length)))
            for k in range(0, len(group), step):
                kept.update(zip(group[k : k + step], search(group[k : k + step]), strict=True))
        for k, cut in open_cuts:
            out[k] = b"".join(map(get, cut))
        for length, group in by_length.items():
            if length > KEPT_LENGTH:
                for w in group:
                    del kept[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Pieces to text: bytes joined, the space put first taken away. Bytes that are no UTF-8 become U+FFFD."""
        some = (ids[k : k + PART_WORDS].tolist() for k in range(0, len(ids), PART_WORDS))
        text = b"".join([b"".join(map(self.table.__getitem__, x)) for x in some]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def coder(path: str) -> PieceCoder:
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode(docs: DataFrame, model: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """Adds ``into``: the piece ids of each whole text (empty for null and empty texts). A column of that name is replaced."""

    def add(texts: list) -> list[pa.Array]:
        found = coder(model).encode(texts)
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found])))
        flat = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))]

    return map_texts(docs.drop(into).withColumn("__text", F.col(text_col)), "__text", add, [pa.field(into, pa.list_(pa.int32()))], f"`{into}` array<int>")


def decode(coded: DataFrame, model: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds ``into``: the text of each row's ids (null ids: null). A column of that name is replaced."""
    fields = [*coded.drop(into).schema.fields]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            c = coder(model)
            texts = [None if ids is None else c.decode(np.array(ids, np.int64)) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, into])

    return coded.drop(into).mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{into}` string"]))


def encode_checked(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode it again in one pass: adds ids, n_pieces, pieces_crc32 (of the ids as little-endian
    32-bit integers), decoded_chars and same (whether the decoded text equals the text; null counts as empty).

    Texts that hold U+2581 themselves come back with spaces in its place.
    Columns of these names in the input are replaced.
    """

    def add(texts: list) -> list[pa.Array]:
        c = coder(model)
        ids = c.encode(texts)
        back = [c.decode(np.frombuffer(x, "<u4")) for x in ids]
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
        return [
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32), pa.int32())),
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            pa.array([len(t) for t in back], pa.int64()),
            pa.array([(t or "") == b for t, b in zip(texts, back, strict=True)], pa.bool_()),
        ]

    fields = [pa.field("ids", pa.list_(pa.int32())), pa.field("n_pieces", pa.int64()), pa.field("pieces_crc32", pa.int64()), pa.field("decoded_chars", pa.int64()), pa.field("same", pa.bool_())]
    source = docs.drop(*[f.name for f in fields]).withColumn("__text", F.col(text_col))
    return map_texts(source, "__text", add, fields, "ids array<int>, n_pieces long, pieces_crc32 long, decoded_chars long, same boolean")
