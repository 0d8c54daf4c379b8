"""SentencePiece encoding with sampled segmentations, and lossless decoding.

All ways to cut a text into pieces form a lattice. A segmentation is drawn with a probability
proportional to the product of its pieces' weights: a forward pass sums the weights of all
paths to each position, and a backward walk from the end draws one piece after another. The
random numbers are a function of the row's key, the word's place and the step, so a row gets
the same segmentation in every run, batch and partition.

No piece of such vocabularies holds a word mark after another letter, so the lattice falls
apart into words, and the different words of a batch are filtered together in flat arrays.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from bizmetrics.llm.common import ship

MARK = "▁"
#: Words sampled at once, and different words whose lattices are filtered at once.
BATCH, FILTERED = 60_000, 15_000
#: Letters with a column of their own in the trie's table.
DENSE = 96
_WORD = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's mixing step."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattices:
    """The filtered lattices of some different words (without their mark): for each place in each word, the
    pieces that end there and the share of the paths that come by each."""

    def __init__(self, model: "Model", words: list[str]):
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        joined = MARK + MARK.join(words)
        self.letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        # Node numbers: a marked word of n letters has n + 1 nodes.
        self.first = np.r_[0, np.cumsum(sizes + 1)]
        word = np.repeat(np.arange(len(words)), sizes)
        starts, stops, ids = model.edges(self.letters, np.arange(len(self.letters)) + word, (self.first[1:] - 1)[word])
        order = np.argsort(stops, kind="stable")
        self.starts, stops, self.ids = starts[order], stops[order], ids[order]
        weights = model.weights[self.ids]
        heads = np.nonzero(np.r_[True, stops[1:] != stops[:-1]])[0]
        nodes, counts = stops[heads], np.diff(np.r_[heads, len(stops)])
        self.head = np.zeros(self.first[-1], np.int64)
        self.head[nodes] = heads
        depth = np.arange(self.first[-1]) - np.repeat(self.first[:-1], sizes + 1)
        alpha = np.zeros(self.first[-1])
        share = np.zeros(len(stops))
        # Nodes of equal depth are filtered at once, in order of depth; every node has a piece that ends there.
        deep = depth[nodes]
        by_depth = np.argsort(deep.astype(np.int16) if deep.max() < 1 << 15 else deep, kind="stable")
        cuts = np.r_[np.nonzero(np.r_[True, np.diff(deep[by_depth]) != 0])[0], len(by_depth)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            here = by_depth[lo:hi]
            n = counts[here]
            group = np.cumsum(n) - n
            at = np.repeat(heads[here] - group, n) + np.arange(n.sum())
            score = alpha[self.starts[at]] + weights[at]
            top = np.maximum.reduceat(score, group)
            scaled = np.exp(score - np.repeat(top, n))
            total = np.add.reduceat(scaled, group)
            alpha[nodes[here]] = top + np.log(total)
            share[at] = scaled / np.repeat(total, n)
        # The summed shares of a node's pieces, up to each; the last reaches past any draw.
        summed = np.cumsum(share)
        self.upto = summed - np.repeat(summed[heads] - share[heads], counts)
        self.upto[heads + counts - 1] = 2.0


class Model:
    """A SentencePiece vocabulary with word marks, and weights for its pieces.

    A unigram model's scores are log probabilities and are the weights, times ``alpha``. A BPE
    model's scores are merge ranks, negated; by Zipf's law the weight of rank r is -log(r + 2).
    Control and unknown pieces are never produced; a letter that isn't a piece falls back to its
    bytes, as does a word mark that stands in the text itself.
    """

    def __init__(self, path: str, alpha: float):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lib.get_piece_size()
        self.bytes_of = np.empty(count, object)
        self.byte_ids = np.zeros(256, np.int64)
        normal: dict[str, int] = {}
        for i in range(count):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
                self.bytes_of[i] = b""
            else:
                normal[piece] = i
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece goes on across a word mark")
        scores = np.array([lib.get_score(i) for i in range(count)])
        ranked = all(scores[i] <= 0 and scores[i] == int(scores[i]) for i in normal.values())
        self.weights = alpha * (-np.log(2 - scores) if ranked else scores)
        self.weights[self.byte_ids] = 0.0  # a fallback is the only way past its letter
        self.is_byte = np.zeros(count, bool)
        self.is_byte[self.byte_ids] = True
        self._grow(normal)

    def _grow(self, pieces: dict[str, int]) -> None:
        """The trie of the pieces: sorted keys of (node, letter) and the nodes they lead to."""
        child: dict[tuple[int, int], int] = {}
        ends = [-1]
        for piece, i in pieces.items():
            node = 0
            for letter in map(ord, piece):
                if (node, letter) not in child:
                    child[node, letter] = len(ends)
                    ends.append(-1)
                node = child[node, letter]
            ends[node] = i
        keys = np.array([n << 21 | c for n, c in child], np.int64)
        order = np.argsort(keys)
        self.keys, self.leads, self.ends = keys[order], np.array(list(child.values()))[order], np.array(ends)
        # The commonest letters have a dense table; the others are searched for.
        common = Counter(c for _, c in child).most_common(DENSE)
        self.dense = np.full((len(ends), len(common)), -1, np.int32)
        self.column = np.full(0x110000, -1, np.int16)
        self.column[[c for c, _ in common]] = np.arange(len(common))
        for (n, c), to in child.items():
            if self.column[c] >= 0:
                self.dense[n, self.column[c]] = to

    def _child(self, where: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The trie's node below each, or -1."""
        column = self.column[letters]
        to = self.dense[where, column]
        rare = np.nonzero(column < 0)[0]
        if len(rare):
            keys = where[rare].astype(np.int64) << 21 | letters[rare]
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            to[rare] = np.where(self.keys[found] == keys, self.leads[found], -1)
        return to

    def edges(self, letters: np.ndarray, node: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start node, end node, piece) of every piece that stands somewhere in the words. A fallback to bytes
        has the id of its letter's first byte piece."""
        starts, stops, ids = [], [], []
        at, where = np.arange(len(letters)), np.zeros(len(letters), np.int32)
        single = np.zeros(len(letters), bool)
        step = 0
        while len(at):
            where = self._child(where, letters[at + step])
            on = where >= 0
            at, where = at[on], where[on]
            piece = self.ends[where]
            whole = piece >= 0
            begun = node[at[whole]]
            starts.append(begun)
            stops.append(begun + step + 1)
            ids.append(piece[whole].astype(np.int32))
            if step == 0:
                single[at[whole]] = True
            step += 1
            more = node[at] + step < end[at]
            at, where = at[more], where[more]
        alone = np.nonzero(~single)[0]
        starts.append(node[alone])
        stops.append(node[alone] + 1)
        lead = [chr(c).encode("utf-8", "surrogatepass")[0] if c != FALLBACK_MARK else MARK.encode()[0] for c in letters[alone].tolist()]
        ids.append(self.byte_ids[np.array(lead, np.int64)].astype(np.int32))
        return np.concatenate(starts), np.concatenate(stops), np.concatenate(ids)

    def sample(self, texts: Sequence[str | None], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and piece ids of one sampled segmentation per text."""
        counts = np.zeros(len(texts), np.int64)
        out: list[np.ndarray] = [np.empty(0, np.int32)]
        for rows, words, places in self._words(texts):
            number = dict(zip(dict.fromkeys(words), range(len(words))))
            kinds = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            distinct = list(number)
            parts = []
            for lo in range(0, len(distinct), FILTERED):
                some = distinct[lo:lo + FILTERED]
                mine = np.nonzero((kinds >= lo) & (kinds < lo + FILTERED))[0] if len(distinct) > FILTERED else np.arange(len(kinds))
                ids, whose, step = self._walk(Lattices(self, some), kinds[mine] - lo, seeds[rows[mine]], places[mine])
                parts.append((ids, mine[whose], step))
            ids, whose, step = (np.concatenate(x) for x in zip(*parts))
            pieces = np.bincount(whose, minlength=len(words))
            if (step & 3).any():
                ordered = ids[np.lexsort((-step, whose))]
            else:
                ordered = np.empty(len(ids), np.int32)
                ordered[np.cumsum(pieces)[whose] - 1 - (step >> 2)] = ids
            out.append(ordered.astype(np.int32))
            counts += np.bincount(rows, pieces, minlength=len(texts)).astype(np.int64)
        return np.r_[0, np.cumsum(counts)], np.concatenate(out)

    def _words(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
        """Words in order, each without its first mark, with their text's number and their place in it, some
        ``BATCH`` at once. A run of spaces goes with the word after it."""
        words: list[str] = []
        runs: list[tuple[int, int, int]] = []

        def batch():
            row, first, size = np.array(runs).T
            ends = np.cumsum(size)
            return np.repeat(row, size), words, np.arange(len(words)) + np.repeat(first - ends + size, size)

        for i, text in enumerate(texts):
            if not text:
                continue
            marked = " " + text
            if "  " in marked or MARK in marked:
                found = [w[1:] for w in _WORD.findall(marked.replace(MARK, chr(FALLBACK_MARK)).replace(" ", MARK))]
            else:
                found = text.split(" ")
            for lo in range(0, len(found), BATCH):
                some = found[lo:lo + BATCH] if len(found) > BATCH else found
                words += some
                runs.append((i, lo, len(some)))
                if len(words) >= BATCH:
                    yield batch()
                    words, runs = [], []
        if words:
            yield batch()

    def _walk(self, lattices: Lattices, kinds: np.ndarray, seeds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece ids drawn from the words' ends to their starts, whose they are, and in which step (times 4, less
        the place of a further byte of a letter)."""
        first, at = lattices.first[kinds], lattices.first[kinds + 1] - 1
        stream = _mixed(seeds + np.uint64(0x9E3779B97F4A7C15) * (places.astype(np.uint64) + np.uint64(1)))
        on = np.arange(len(kinds))
        ids, owner, steps = [], [], []
        step = 0
        while len(on):
            draw = _mixed(stream[on] + np.uint64(0xD1342543DE82EF95 * (step + 1) % (1 << 64)))
            share = (draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            edge = lattices.head[at[on]]
            short = np.nonzero(lattices.upto[edge] <= share)[0]
            while len(short):
                edge[short] += 1
                short = short[lattices.upto[edge[short]] <= share[short]]
            piece, start = lattices.ids[edge], lattices.starts[edge]
            ids.append(piece)
            owner.append(on)
            steps.append(np.full(len(on), step << 2, np.int32))
            fell = np.nonzero(self.is_byte[piece])[0]
            if len(fell):  # a letter that fell back has further bytes
                letters = lattices.letters[start[fell] - kinds[on[fell]]]
                for n, letter in zip(fell[letters > 0x7F].tolist(), letters[letters > 0x7F].tolist()):
                    rest = (MARK if letter == FALLBACK_MARK else chr(letter)).encode("utf-8", "surrogatepass")[1:]
                    ids.append(self.byte_ids[list(rest)])
                    owner.append(np.full(len(rest), on[n]))
                    steps.append(((step << 2) - 1 - np.arange(len(rest))).astype(np.int32))
            at[on] = start
            on = on[start > first[on]]
            step += 1
        return np.concatenate(ids), np.concatenate(owner), np.concatenate(steps)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.bytes_of[ids].tolist())[1:].decode("utf-8", "replace")


#: Stands for a word mark that the text itself holds; no text holds a lone surrogate.
FALLBACK_MARK = 0xDFFF


@lru_cache(maxsize=2)
def model(path: str, alpha: float = 1.0) -> Model:
    return Model(path, alpha)


def _seeds(keys: list[str], seed: int) -> np.ndarray:
    """A seed from each row's key (32 hex digits) and the caller's."""
    return np.array([(int(k[:16], 16) + seed) % (1 << 64) for k in keys], np.uint64)


class _Texts:
    """The texts of an Arrow array, made one at a time."""

    def __init__(self, texts: pa.Array):
        self.texts = texts

    def __len__(self) -> int:
        return len(self.texts)

    def __iter__(self) -> Iterator[str | None]:
        return (t.as_py() for t in self.texts)


def _encoded(keys: pa.Array, texts: pa.Array, path: str, alpha: float, seed: int) -> pa.Array:
    offsets, ids = model(path, alpha).sample(_Texts(texts), _seeds(keys.to_pylist(), seed))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def _decoded(lists: pa.Array, path: str) -> Iterator[str]:
    ids, offsets, read = lists.values.to_numpy(), lists.offsets.to_numpy(), model(path).decode
    return (read(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:]))


def encode(docs: DataFrame, vocabulary: str, alpha: float = 1.0, seed: int = 0, key_col: str = "key",
           text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """``docs`` with the piece ids of one sampled segmentation of each text in ``ids_col``.

    The draw is a function of ``key_col`` (a hexadecimal digest) and ``seed``: repeated rows are cut alike. A
    greater ``alpha`` prefers pieces of greater weight. ``vocabulary`` is the path of a model file, the same
    on every executor. A null or empty text has no pieces. Long texts are sampled in pieces of
    ``BATCH`` words, whole.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def cut(keys: pa.Array, texts: pa.Array) -> pa.Array:
        return _encoded(keys, texts, vocabulary, alpha, seed)

    return docs.withColumn(ids_col, cut(F.col(f"`{key_col}`"), F.col(f"`{text_col}`")))


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its piece ids in ``text_col``; no pieces, or null, give the empty text."""
    ship(encoded.sparkSession)

    @F.arrow_udf("string")
    def joined(lists: pa.Array) -> pa.Array:
        return pa.array(_decoded(lists, vocabulary), pa.string())

    return encoded.withColumn(text_col, joined(F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, vocabulary: str, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """From rows (key, doc_id, text): ``doc_id``, ``n_pieces``, ``piece_ids``, and ``lossless``, whether they decode to
    the text again (a null counts as empty). Each text is encoded and decoded in one pass, by the same functions as ``encode`` and ``decode``.
    Repeated rows and null ids each get their row; an empty table gives none."""
    ship(docs.sparkSession)

    @F.arrow_udf("struct<piece_ids:array<int>,lossless:boolean>")
    def both(keys: pa.Array, texts: pa.Array) -> pa.Array:
        ids = _encoded(keys, texts, vocabulary, alpha, seed)
        same = pa.array([(t or "") == d for t, d in zip(_Texts(texts), _decoded(ids, vocabulary))], pa.bool_())
        return pa.StructArray.from_arrays([ids, same], ["piece_ids", "lossless"])

    made = docs.select("doc_id", both("key", "text").alias("r"))
    return made.select("doc_id", F.size("r.piece_ids").cast("bigint").alias("n_pieces"), "r.piece_ids", "r.lossless")
