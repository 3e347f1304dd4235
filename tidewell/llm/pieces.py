"""SentencePiece encoding and decoding by one forward pass over a trie of marked words.

Texts become marked words: a leading mark, blanks as marks, cut before every run of marks. No piece
has a mark after another character (checked when the model is read), so words are independent. The
distinct words of a batch are sorted, which is a depth-first walk of their trie: forward states of
the prefix that a word shares with the one before are used again.

The forward state of a prefix is its best score and last piece (Viterbi), which gives the ids of a unigram
model, and with by_score those of the best sum of any model's scores. The merges of a BPE model have an
order that no sum of scores expresses, so the ids that the model's own library gives come from a second part
of the state: the one last piece that fits, as a piece fits behind another if merging their joined text gives
the two back. Where a prefix has no such piece the word is merged step by step instead. Both parts are carried
along, so a text has the score of the best path beside its ids.

Edge cases: null and empty texts give no ids; an unknown character gives its UTF-8 byte pieces (or
the unknown id where the model has none); very long words cost linear work; decoding turns U+2581
into a blank, as that is how blanks are stored, so only texts without it come back exactly; ids
outside the vocabulary decode to U+FFFD; rows are independent, repeated rows and other columns do
not matter; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
NEAR = 5
NORMAL, UNKNOWN, USER, UNUSED, BYTE = 1, 2, 4, 5, 6


class _Rows(dict):
    """Numbers words in the order they are met; `new` has those that have no pieces yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Pieces:
    """The vocabulary of a model file, and the ids of marked words seen so far (at most `most` of them)."""

    def __init__(self, model: bytes, most: int = 400_000, by_score: bool = False):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        if m.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without normalisation are supported")
        self.bpe, self.most = m.trainer_spec.model_type == BPE and not by_score, most
        self.dummy = m.normalizer_spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (NORMAL, USER, UNUSED)}
        self.score = {p.piece: p.score for p in m.pieces if p.type in (NORMAL, USER, UNUSED)}
        self.given = dict(self.score)
        if self.bpe:  # only their order counts for merging
            self.score = {p: -float(k) for k, p in enumerate(sorted(self.score, key=self.score.__getitem__, reverse=True))}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.longest = max(map(len, self.ids))
        by_end: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > NEAR:
                by_end.setdefault(piece[-NEAR - 1:], set()).add(len(piece))
        #: the last characters of a long piece -> the lengths of long pieces that end so, longest first
        self.long = {k: tuple(sorted(v, reverse=True)) for k, v in by_end.items()}
        #: up to NEAR last characters of a prefix -> (length, id) of the short pieces it ends with, longest first
        self.short: dict[str, tuple[tuple[int, int], ...]] = {}
        if bad := [p for p in self.ids if MARK in p.lstrip(MARK)]:
            raise ValueError(f"words are not independent: {bad[:3]}")
        texts = [p.piece.replace(MARK, " ").encode() if p.type in (NORMAL, USER, UNUSED) else b"" for p in m.pieces]
        for v, i in self.byte.items():
            texts[i] = bytes([v])
        texts[self.unknown] = " ⁇ ".encode()
        self.texts = texts
        # a character in no piece joins nothing: the line end, if it is one, parts words too
        end = "" if any("\n" in p for p in self.ids) else "\n"
        self.cut = re.compile(f"{MARK}+[^{MARK}{end}]*|[^{MARK}{end}]+" + f"|{end}+" * bool(end))
        self.name = {i: p for p, i in self.ids.items()}
        order = sorted(self.ids, key=self.score.__getitem__, reverse=True)
        self.rank = {self.ids[p]: k for k, p in enumerate(order)}
        #: the score of a character in no piece, and scores by id; -1, such a character, is the last
        self.worst = min(self.given.values(), default=0.0) - 10
        self.points = [0.0] * len(texts) + [self.worst]
        for i, p in self.name.items():
            self.points[i] = self.given[p]
        self.fits: dict[int, bool] = {}
        #: id -> ids of the two parts its last merge joined; None for one character, False if merging its text does not give it
        self.halves: dict[int, tuple[int, int] | None | bool] = {}
        self.plain = 0
        self.clear()

    def clear(self) -> None:
        self.row = _Rows()
        self.starts, self.sizes, self.flat, self.tops = array("q"), array("i"), array("i"), array("d")

    def merged(self, word: str) -> list[str]:
        """Pieces by merging the neighbours with the highest score first, the leftmost of equals."""
        part: list[str | None] = list(word)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap = [(-self.score[a + b], i, a + b) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in self.score]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = right[i]
            if part[i] is None or j >= len(part) or len(part[i]) + len(part[j]) != len(joined) or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, None
            right[i] = k = right[j]
            if k < len(part):
                left[k] = i
                if (n := joined + part[k]) in self.score:
                    heapq.heappush(heap, (-self.score[n], i, n))
            if (k := left[i]) >= 0 and (n := part[k] + joined) in self.score:
                heapq.heappush(heap, (-self.score[n], k, n))
        return [p for p in part if p is not None]

    def _parts(self, i: int) -> tuple[int, int] | None | bool:
        out = self.halves.get(i, 0)
        if out == 0:
            piece, out = self.name[i], None
            if len(piece) > 1:
                del self.score[piece]  # merging without the piece itself stops one step before it
                two = self.merged(piece)
                self.score[piece] = -self.rank[i]
                out = tuple(map(self.ids.get, two)) if len(two) == 2 and None not in map(self.ids.get, two) else False
            self.halves[i] = out
        return out

    def _fit(self, a: int, b: int) -> bool:
        """Whether piece b can stand behind piece a: undoes the merges at the border, the latest first, and
        looks whether the two symbols that then meet would have been joined before."""
        limit = 1 << 60
        rank, name, ids = self.rank, self.name, self.ids
        while True:
            joined = ids.get(name[a] + name[b])
            if joined is not None and rank[joined] < limit:
                return False
            if rank[a] > rank[b]:
                limit, half = rank[a], self._parts(a)
                if half:
                    a = half[1]
                    continue
                limit, half = rank[b] + 1, self._parts(b)
                if not half:
                    return True
                b = half[0]
            else:
                limit, half = rank[b] + 1, self._parts(b)
                if half:
                    b = half[0]
                    continue
                limit, half = rank[a], self._parts(a)
                if not half:
                    return True
                a = half[1]

    def _best(self, word: str, i: int, best: list[float], worst: float) -> tuple[float, str]:
        """Unigram: the best score of word[:i] and its last piece."""
        out = (best[i - 1] + worst, word[i - 1])
        for j in range(max(0, i - self.longest), i):
            s = self.score.get(word[j:i])
            if s is not None and best[j] + s > out[0]:
                out = (best[j] + s, word[j:i])
        return out

    def learn(self) -> None:
        """Finds the ids of words met for the first time, in one depth-first walk of their trie."""
        words, self.row.new = self.row.new, []
        row, flat, starts, sizes = self.row, self.flat, self.starts, self.sizes
        starts.extend([0] * (len(row) - len(starts)))
        sizes.extend([0] * (len(row) - len(sizes)))
        tops = self.tops
        tops.extend([0.0] * (len(row) - len(tops)))
        ids, fits, short, long = self.ids, self.fits, self.short, self.long
        if len(fits) > 1_000_000:
            fits.clear()
        if len(short) > 300_000:
            short.clear()
        # for each prefix: its last piece's id (-1: a character in no piece, -2: none fits) and length, its best score
        before, last, size, best = "", [-1], [0], [0.0]
        worst, points = self.worst, self.points
        for word in sorted(words):
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del last[same + 1:], size[same + 1:], best[same + 1:]
            for i in range(same + 1, len(word) + 1):
                if not self.bpe:
                    s, p = self._best(word, i, best, worst)
                    best.append(s)
                    last.append(ids.get(p, -1))
                    size.append(len(p))
                    continue
                end = word[i - NEAR if i > NEAR else 0:i]
                cand = short.get(end)
                if cand is None:
                    cand = tuple((n, ids[end[-n:]], points[ids[end[-n:]]]) for n in range(len(end), 1, -1) if end[-n:] in ids and self._parts(ids[end[-n:]]) is not False)
                    one = ids.get(end[-1], -1)
                    cand = short[end] = (*cand, (1, one, points[one]))
                if i > NEAR and (more := long.get(word[i - NEAR - 1:i])):
                    more = [(n, ids[word[i - n:i]]) for n in more if n <= i and word[i - n:i] in ids]
                    if more:
                        cand = (*((n, p, points[p]) for n, p in more if self._parts(p) is not False), *cand)
                top, found, length = -1e300, -2, 1
                for n, piece, point in cand:
                    if (v := best[i - n] + point) > top:
                        top = v
                    if found != -2 or (ahead := last[i - n]) == -2:
                        continue
                    if i > n and ahead >= 0 and piece >= 0:
                        key = ahead << 32 | piece
                        fit = fits.get(key)
                        if fit is None:
                            fit = fits[key] = self._fit(ahead, piece)
                        if not fit:
                            continue
                    found, length = piece, n
                best.append(top)
                last.append(found)
                size.append(length)
            before, i, parts = word, len(word), []
            while i > 0 and last[i] != -2:
                parts.append(last[i] if last[i] >= 0 else word[i - 1])
                i -= size[i]
            if i:
                self.plain += 1
                parts = [ids.get(p, p) for p in reversed(self.merged(word))]
            n = row[word]
            tops[n] = best[-1]
            starts[n] = begin = len(flat)
            parts.reverse()
            try:
                flat.extend(parts)
            except TypeError:  # a character in no piece
                del flat[begin:]
                for p in parts:
                    if p.__class__ is int:
                        flat.append(p)
                    elif self.byte:
                        flat.extend(self.byte[v] for v in p.encode("utf-8", "replace"))
                    else:
                        flat.append(self.unknown)
            sizes[n] = len(flat) - begin

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        s = (MARK + text if self.dummy else text).replace(" ", MARK)
        return self.cut.findall(s)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        return self.scored(texts)[0]

    def scored(self, texts: list[str | None]) -> tuple[pa.ListArray, np.ndarray]:
        """The ids of each text, and the score of its best path: the sum of those of its words."""
        lists = [self.words(t or "") for t in texts]
        if len(self.row) > self.most:
            self.clear()
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=sum(map(len, lists)))
        if self.row.new:
            self.learn()
        starts, sizes, flat = (np.frombuffer(x, dtype=d) if x else np.zeros(0, dtype=d) for x, d in ((self.starts, np.int64), (self.sizes, np.int32), (self.flat, np.int32)))
        size = sizes[rows].astype(np.int64)
        ends = np.cumsum(size)
        at = np.repeat(starts[rows] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0) if len(rows) else np.zeros(0, dtype=np.int64)
        total = np.concatenate([[0], ends])[np.cumsum([0] + [len(ws) for ws in lists])]
        sums = np.concatenate([[0.0], np.cumsum(np.frombuffer(self.tops, dtype=np.float64)[rows] if len(rows) else np.zeros(0))])
        ends = np.cumsum([0] + [len(ws) for ws in lists])
        ids = pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(flat[at] if len(at) else np.zeros(0, dtype=np.int32), pa.int32()))
        return ids, sums[ends[1:]] - sums[ends[:-1]]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        n = len(self.texts)
        try:
            out = b"".join(map(self.texts.__getitem__, ids)) if not len(ids) or min(ids) >= 0 else None
        except IndexError:
            out = None
        if out is None:
            out = b"".join(self.texts[i] if 0 <= i < n else "�".encode() for i in ids)
        s = out.decode("utf-8", "replace")
        return s[1:] if self.dummy and s.startswith(" ") else s


_LOADED: dict[int, Pieces] = {}


def _loaded(model: bytes, by_score: bool = False) -> Pieces:
    """The vocabulary, read once in each worker process and kept with its words for the tasks to come."""
    key = hash((model, by_score))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model, by_score=by_score)
    return _LOADED[key]


def _model(spark: SparkSession, path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, block: int = 256, check: bool = False, by_score: bool = False) -> DataFrame:
    """doc_id, ids array<int>, best double of every row; with check also whether decoding the ids gives the text back.

    best: the score of the best path through the pieces. by_score: the ids of that path, whatever kind of model it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_model(docs.sparkSession, model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(shared.value, by_score)
        for b in batches:
            for a in range(0, b.num_rows, block):
                part = b.slice(a, block)
                texts = part.column(1).to_pylist()
                ids, best = m.scored(texts)
                cols, names = [part.column(0), ids, pa.array(best, pa.float64())], ["doc_id", "ids", "best"]
                if check:
                    flat, off = ids.values.to_numpy().tolist(), ids.offsets.to_numpy()
                    same = [m.decode(flat[off[i]:off[i + 1]]) == (t or "").replace(MARK, " ") for i, t in enumerate(texts)]
                    cols.append(pa.array(same))
                    names.append("same")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, ids array<int>, best double" + ", same boolean" * check
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(coded: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, text of every row of (doc_id, ids)."""
    shared = coded.sparkSession.sparkContext.broadcast(_model(coded.sparkSession, model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _loaded(shared.value)
        for b in batches:
            texts = [m.decode([i if i is not None else -1 for i in x or ()]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as ids, and whether it comes back from them."""
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), check=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.col("best").alias("best_score"), "same")
