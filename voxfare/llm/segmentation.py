"""N-best segmentation into the pieces of a SentencePiece vocabulary, and decoding.

The lattice of a text has a node at each character boundary and an arc for each piece that matches there. A forward
Viterbi pass gives every node the score of the best way to it. The search then runs backward from the end: a
partial path is worth its own score plus the forward score of its node, which is exact, so A* draws complete
paths in descending order of score. Scores are integers, so sums have no rounding and ties stay ties.

No piece has a space after another character, so each node before a run of spaces is one that all paths
pass. The search runs between such nodes, and the best combinations of the words' paths are the best paths of the whole
text. The forward pass also gives the score that a word loses with its second-best path. Among the n best paths of a text only the
n - 1 words that lose least can leave their best path, so A* runs for these words alone. Words are kept.

The model file ranks pieces. The score of a piece is the logarithm of its rank, as under Zipf's law.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfare.llm.common import slices, texts_of

SCALE = 1_000_000
#: Words kept per worker; beyond that new ones are searched each time they come.
MAX_KEPT = 800_000
WORDS = re.compile(r" *[^ ]+| +")


@dataclass(frozen=True)
class Pieces:
    """Where the vocabulary file is; opened inside each task."""

    path: str

    def open(self, best: int) -> Lattice:
        return _opened(self.path, best)


@cache
def _opened(path: str, best: int) -> Lattice:
    return Lattice(sentencepiece.SentencePieceProcessor(model_file=path), best)


class Lattice(dict):
    """By word: score, number of pieces and ids (little-endian 32-bit bytes) of its best path, and the score that the
    second-best path loses (inf: there is none). ``lost`` holds words whose ids do not decode to them."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, best: int):
        super().__init__()
        self.ways: dict[str, list[tuple[int, int, bytes]]] = {}
        self.lost: set[str] = set()
        self.best = best
        size = model.get_piece_size()
        self.octets: list[bytes] = [b""] * size
        self.scores: dict[str, tuple[int, int]] = {}
        self.byte_ids = [0] * 256
        self.byte_score = -round(2 * math.log(size) * SCALE)
        for number in range(size):
            piece = model.id_to_piece(number)
            if model.is_byte(number):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.octets[number] = number, bytes([value])
            elif not (model.is_control(number) or model.is_unknown(number)):
                written = piece.replace("▁", " ")
                self.octets[number] = written.encode()
                if " " not in written.lstrip(" "):
                    self.scores[written] = (-round(math.log(2 - model.get_score(number)) * SCALE), number)
        #: Every beginning of a piece; those that are no pieces have None.
        self.begun: dict[str, tuple[int, int] | None] = {w[:n]: None for w in self.scores for n in range(1, len(w))} | self.scores

    def bytes_of(self, c: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))

    def arcs(self, word: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each node the arcs that end there: (start, score, ids). A character without a piece is its bytes."""
        into: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(len(word) + 1)]
        begun = self.begun
        for start in range(len(word)):
            for end in range(start + 1, len(word) + 1):
                hit = begun.get(word[start:end], False)
                if hit is False:
                    break
                if hit:
                    into[end].append((start, hit[0], (hit[1],)))
            if word[start] not in self.scores:
                ids = self.bytes_of(word[start])
                into[start + 1].append((start, self.byte_score * len(ids), ids))
        return into

    def __missing__(self, word: str) -> tuple[int, int, bytes, float]:
        """The forward pass: best and second-best score of each node; among equals the arc from the right wins."""
        n = len(word)
        first, second = [0] + [-math.inf] * n, [-math.inf] * (n + 1)
        back, names = [0] * (n + 1), [0] * (n + 1)  # start and piece of the best arc into each node
        spelt: dict[int, tuple[int, ...]] = {}  # nodes reached by the bytes of a character
        begun = self.begun.get
        for start, letter in enumerate(word):
            best, next_best = first[start], second[start]
            end = start + 1
            hit = begun(letter, False)
            if not hit:
                spelt[end] = ids = self.bytes_of(letter)
                name, gain = -1, self.byte_score * len(ids)
            else:
                gain, name = hit
            while True:
                score = best + gain
                if score >= first[end]:
                    other = next_best + gain
                    second[end] = first[end] if first[end] > other else other
                    first[end] = score
                    back[end] = start
                    names[end] = name
                elif score > second[end]:
                    second[end] = score
                if hit is False:
                    break
                end += 1
                while end <= n and (hit := begun(word[start:end], False)) is None:
                    end += 1
                if end > n or hit is False:
                    break
                gain, name = hit
        path: list[int] = []
        node = n
        while node:
            if names[node] >= 0:
                path.append(names[node])
            else:
                path += reversed(spelt[node])
            node = back[node]
        path.reverse()
        data = array("I", path).tobytes()
        made = (first[n], len(path), data, first[n] - second[n])
        if self.plain(data) != word:
            self.lost.add(word)
        if len(self) < MAX_KEPT and n <= 64:
            self[word] = made
        return made

    def ways_of(self, word: str) -> list[tuple[int, int, bytes]]:
        """The n best paths of a word, best first: backward A* search, exact by the scores of the forward pass."""
        if word in self.ways:
            return self.ways[word]
        into = self.arcs(word)
        forward = [0]
        for arcs in into[1:]:
            forward.append(max(forward[a] + s for a, s, _ in arcs))
        found: list[tuple[int, int, bytes]] = []
        heap = [(-forward[-1], 0, len(word), 0, None)]
        made = 0
        while heap and len(found) < self.best:
            _, _, node, score, path = heapq.heappop(heap)
            if node == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((score, len(ids), array("I", ids).tobytes()))
                continue
            for start, gain, ids in into[node]:
                made -= 1  # among equals the newest, so ties are followed to their end
                heapq.heappush(heap, (-(score + gain + forward[start]), made, start, score + gain, (ids, path)))
        if len(self.ways) < MAX_KEPT and len(word) <= 64:
            self.ways[word] = found
        return found

    def segment(self, text: str) -> list[tuple[int, int, bytes, bool]]:
        """The best segmentations of a text, best first: score, number of pieces, ids, and whether they decode to the text.

        The empty text has one, without ids.
        """
        parts = WORDS.findall(" " + text) if text else []
        scores, counts, whole, gaps = map(list, zip(*map(self.__getitem__, parts))) if parts else ([], [], [], [])
        score, count, data = sum(scores), sum(counts), b"".join(whole)
        restored = not self.lost or self.lost.isdisjoint(parts)
        ways: list[tuple[int, tuple[tuple[int, int], ...]]] = [(0, ())]
        paths = {}
        for _ in range(min(self.best - 1, len(gaps))):
            least = min(gaps)
            if least == math.inf:
                break
            i = gaps.index(least)
            gaps[i] = math.inf
            paths[i] = self.ways_of(parts[i])
            ways = heapq.nsmallest(self.best, ((c + paths[i][0][0] - p[0], (*w, (i, j)) if j else w) for c, w in ways for j, p in enumerate(paths[i])))
        out = []
        for loss, changes in ways:
            ids, pieces, same = data, count, restored
            for i, j in sorted(changes, reverse=True):  # from the right, so that places further left stay
                at = 4 * sum(counts[:i])
                new = paths[i][j]
                ids = ids[:at] + new[2] + ids[at + 4 * counts[i] :]
                pieces += new[1] - counts[i]
                same = same and self.plain(new[2]) == parts[i]
            out.append((score - loss, pieces, ids, same))
        return out

    def plain(self, ids: bytes) -> str:
        return b"".join(map(self.octets.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "surrogatepass")

    def decode(self, ids: bytes) -> str:
        """The text of a segmentation, without the space put before it. Pieces decode one by one, so a text is restored
        where all its words are."""
        return self.plain(ids)[1:]


def segment_documents(docs: DataFrame, pieces: Pieces, best: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The ``best`` segmentations of each whole text: ``key``, rank (from 1), score, n_pieces, ids_crc32 and restored.

    ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit integers; ``restored`` says whether they decode to
    the text. A text with fewer segmentations gives fewer rows; an empty or null text gives one, without pieces.
    Null keys stay null, repeated rows each give their rows, an empty table gives an empty result. Other columns are not
    read.
    """
    names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "restored"]
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = pieces.open(best)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, t in zip(part.column("doc_id").to_pylist(), texts_of(part, "text")):
                    for rank, (score, n, ids, restored) in enumerate(lattice.segment(t), 1):
                        rows.append((doc, rank, score / SCALE, n, zlib.crc32(ids), restored))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=names)

    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(run, "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, restored boolean").withColumnRenamed("doc_id", key)
