"""SentencePiece lattices: n-best segmentation, decoding, and token counts over a shared trie.

The vocabulary is that of a public SentencePiece model; it is read, never trained. A piece's score is the unigram
log-probability that its rank gives under Zipf's law, -ln(rank + 2); a character outside the vocabulary goes to byte pieces,
each scored below every other piece. The file writes a blank as the mark U+2581; here pieces are held with blanks. One blank
is put before the text, and its lattice splits before each blank that follows another character, because no piece crosses
there: a unit is a run of blanks with the word after it, and pieces that are runs of blanks are pieces like others. So
segmentation loses nothing: decoding gives back every text exactly, a literal U+2581 included (it is spelt in bytes).
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from array import array
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, TwoGenerations

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
MARK = "▁"


class Pieces:
    """score and id of each piece, written with blanks; byte pieces by value; spelling of each id.

    Methods take units: a unit begins with a blank (or the mark in its place); a mark further on is a plain character.
    """

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.spelt: list[str] = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            self.spelt.append(p)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if " " in p or MARK in p.lstrip(MARK):
                    raise ValueError(f"piece {i} crosses units: {p!r}")
                self.id[p.replace(MARK, " ")] = i
        for rank, p in enumerate(self.id):
            self.score[p] = -math.log(rank + 2)
        self.byte_score = -math.log(len(self.id) + 2) - 2.0
        self.longest = max(map(len, self.score))
        #: Score of each piece, -inf for other ends of pieces: a run of characters that isn't here is no end of any piece.
        self.tail = dict.fromkeys((p[i:] for p in self.score for i in range(1, len(p))), -math.inf) | self.score
        self.is_byte = set(self.byte_id)
        of_byte = {i: bytes([b]) for b, i in enumerate(self.byte_id)}
        #: The bytes that each id stands for.
        self.bytes = pa.array([of_byte.get(i) or p.replace(MARK, " ").encode() for i, p in enumerate(self.spelt)], pa.large_binary())

    def edges(self, word: str, end: int):
        """(start, score, pieces) of the lattice's edges into `end`."""
        score = self.score
        if word[0] != " ":
            word = " " + word[1:]
        lone = True
        for start in range(max(0, end - self.longest), end):
            s = score.get(word[start:end])
            if s is not None:
                lone = lone and start < end - 1
                yield start, s, 1
        if lone:
            n = len(word[end - 1].encode("utf-8", "surrogatepass"))
            yield end - 1, n * self.byte_score, n

    def spell(self, word: str, start: int, end: int) -> list[int]:
        p = word[start:end] if start else " " + word[1:end]
        i = self.id.get(p)
        if i is not None:
            return [i]
        return [self.byte_id[b] for b in p.encode("utf-8", "surrogatepass")]

    def forward(self, word: str) -> tuple[array, array, array]:
        """Best score of each prefix, where its last piece starts, and how far another last piece falls behind: 20 bytes a character."""
        best, back, second = array("d", [0.0]), array("i", [0]), array("d", [math.inf])
        tail, byte_score = self.tail.get, self.byte_score
        word = " " + word[1:]
        for end in range(1, len(word) + 1):  # starts go down, the leftmost wins a tie
            at = end - 1
            s = tail(word[at])
            lone = s is None or s == -math.inf
            top = best[at] + (len(word[at].encode("utf-8", "surrogatepass")) * byte_score if lone else s)
            gap, start = math.inf, at if s is not None else 0
            while start > 0:
                start -= 1
                s = tail(word[start:end])
                if s is None:
                    break
                s += best[start]
                if s >= top:
                    gap, top, at = s - top, s, start
                elif top - s < gap:
                    gap = top - s
            best.append(top)
            back.append(at)
            second.append(gap)
        return best, back, second

    def best(self, word: str) -> tuple[bytes, float, float]:
        """Ids of the best segmentation as int32 bytes, its score, and the second best one's distance."""
        word = " " + word[1:]
        best, back, second = self.forward(word)
        ids, end, gap, find = array("i"), len(word), math.inf, self.id.get
        while end > 0:
            start = back[end]
            i = find(word[start:end])
            if i is None:
                ids.extend(reversed(self.spell(word, start, end)))
            else:
                ids.append(i)
            if second[end] < gap:
                gap = second[end]
            end = start
        ids.reverse()
        return ids.tobytes(), best[-1], gap

    @functools.cached_property
    def trie(self) -> Trie:
        return Trie(self)

    def best_many(self, words: list[str], longest: int = 64) -> list[tuple[bytes, float, float]]:
        """best() of each of words, for those of up to `longest` characters at once: the same sums, a column of words a step.

        A word goes to best() if it is longer or its best segmentation spells a character of several bytes.
        """
        words = [" " + w[1:] for w in words]
        out: list = [None] * len(words)
        at = [i for i, w in enumerate(words) if len(w) <= longest]
        at.sort(key=lambda i: -len(words[i]))
        for few in itertools.batched(at, 8192):
            for i, found in zip(few, self.trie.best([words[i] for i in few]), strict=True):
                out[i] = found
        return [self.best(w) if x is None else x for w, x in zip(words, out, strict=True)]

    def n_best(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations: A* backward from the end, in which the forward scores are exact, so each pop is final.

        Costs are compared to nine digits, and of equal ones the path nearest to the start goes on: a run of blanks has very many.
        """
        word = " " + word[1:]
        best, _, _ = self.forward(word)
        order = count()
        heap = [(round(-best[-1], 9), len(word), next(order), 0.0, None)]
        out = []
        while heap and len(out) < n:
            _, end, _, done, path = heapq.heappop(heap)
            if end == 0:
                ids = []
                while path:
                    ids += self.spell(word, *path[0])
                    path = path[1]
                out.append((done, ids))
                continue
            for start, s, _ in self.edges(word, end):
                heapq.heappush(heap, (round(-(best[start] + s + done), 9), start, next(order), done + s, ((start, end), path)))
        return sorted(out, key=lambda x: -x[0])

    def decode(self, ids: list[int]) -> str:
        """The text of ids made by an encoder of this class."""
        spelt, is_byte = self.spelt, self.is_byte
        if is_byte.isdisjoint(ids):
            return "".join([spelt[i] for i in ids]).replace(MARK, " ")[1:]
        out, run = [], bytearray()
        for i in ids:
            if i in is_byte:
                run.append(int(spelt[i][3:5], 16))
                continue
            if run:
                out.append(run.decode("utf-8", "surrogatepass"))
                run.clear()
            out.append(spelt[i].replace(MARK, " "))
        if run:
            out.append(run.decode("utf-8", "surrogatepass"))
        return "".join(out)[1:]

    def spelling(self, flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of the texts whose ids stand one after another in flat, each from its offset on: decode() for many."""
        spelt = self.bytes.take(pa.array(flat))
        ends = np.frombuffer(spelt.buffers()[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        data = spelt.buffers()[2].to_pybytes() if len(flat) else b""
        cut = ends[offsets].tolist()
        return pa.array([data[a + 1 : b] for a, b in itertools.pairwise(cut)], pa.large_binary())


class Trie:
    """The pieces' trie, read from their ends, as sorted arrays: a step from (node, character) is a search among the keys."""

    def __init__(self, pieces: Pieces):
        nodes = {t: i for i, t in enumerate(pieces.tail)}  # a run of characters that ends a piece
        self.score = np.array(list(pieces.tail.values()))
        self.id = np.array([pieces.id[t] if s > -math.inf else -1 for t, s in pieces.tail.items()], np.int32)
        self.byte_score = pieces.byte_score
        self.byte_id = np.array(pieces.byte_id[:128], np.int32)
        pairs = sorted((nodes[t[1:]] << 21 | ord(t[0]), i) for t, i in nodes.items() if len(t) > 1)
        self.keys, self.to = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.first = np.full(0x110000, -1, np.int32)
        for t, i in nodes.items():
            if len(t) == 1:
                self.first[ord(t)] = i

    def best(self, words: list[str]) -> list[tuple[bytes, float, float] | None]:
        """Pieces.best() of words that come longest first; None where a character is spelt in several bytes."""
        size = np.array([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
        n, most = len(words), int(size[0])
        code = np.zeros((most, n), np.int32)
        row = np.repeat(np.arange(n), size)
        code[np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size), row] = chars
        best, second = np.zeros((most + 1, n)), np.full((most + 1, n), math.inf)
        back, piece = np.zeros((most + 1, n), np.int32), np.full((most + 1, n), -1, np.int32)
        for end in range(1, most + 1):
            m = int(np.searchsorted(-size, -end, side="right"))
            c = code[end - 1, :m]
            node = self.first[c]
            score = np.where(node >= 0, self.score[node], -math.inf)
            lone = np.isneginf(score)
            width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            top = best[end - 1, :m] + np.where(lone, width * self.byte_score, score)
            start, ids, gap = np.full(m, end - 1, np.int32), np.where(lone, np.where(c < 0x80, self.byte_id[c & 127], -1), self.id[node]), np.full(m, math.inf)
            rows = np.flatnonzero(node >= 0)
            node = node[rows].astype(np.int64)
            for at in range(end - 2, -1, -1):
                key = node << 21 | code[at, rows]
                where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[where] == key)
                if not len(hit):
                    break
                rows, node = rows[hit], self.to[where[hit]]
                ahead = self.score[node] + best[at, rows] - top[rows]
                won = ahead >= 0  # the leftmost start wins a tie
                gap[rows] = np.where(won, ahead, np.minimum(gap[rows], -ahead))
                r = rows[won]
                top[r], start[r], ids[r] = self.score[node[won]] + best[at, r], at, self.id[node[won]]
            best[end, :m], back[end, :m], piece[end, :m], second[end, :m] = top, start, ids, gap
        at, every, gap = size.copy(), np.arange(n), np.full(n, math.inf)
        path, taken, spelt = np.zeros((most, n), np.int32), np.zeros(n, np.int64), np.ones(n, bool)
        rows = every[at > 0]
        while len(rows):
            here = at[rows]
            path[taken[rows], rows] = ids = piece[here, rows]
            spelt[rows] &= ids >= 0
            gap[rows] = np.minimum(gap[rows], second[here, rows])
            taken[rows] += 1
            at[rows] = back[here, rows]
            rows = rows[at[rows] > 0]
        row = np.repeat(every, taken)
        flat = path[np.repeat(np.cumsum(taken), taken) - 1 - np.arange(len(row)), row].tobytes()
        cut = [0, *(4 * np.cumsum(taken)).tolist()]
        found = zip(itertools.pairwise(cut), best[size, every].tolist(), gap.tolist(), spelt.tolist(), strict=True)
        return [(flat[a:b], s, g) if ok else None for (a, b), s, g, ok in found]


#: Bytes of text that are encoded together, so that a batch of long texts doesn't multiply in memory.
SLICE = 4 << 20


def sliced(batch: pa.RecordBatch, text_col: str):
    """(rows of the batch, their texts without nulls) in slices of SLICE bytes of text, or one longer text."""
    texts = pc.fill_null(batch.column(text_col), "").cast(pa.large_string())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held + n > SLICE and i > first:
            yield batch.slice(first, i - first), texts.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first), texts.slice(first)


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct units without their first blank, the index of each text's units among them, and where each text's begin.

    Single blanks part a text; an empty part is a further blank of the unit of the part behind it, or a unit at the text's end.
    """
    parts = pc.split_pattern(texts, " ")
    coded = pc.dictionary_encode(parts.flatten())
    begin = np.r_[0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))]
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    if "" in words:
        closes = at != words.index("")
        closes[begin[1:] - 1] = True
        ends = np.flatnonzero(closes)
        blanks = np.diff(ends, prepend=-1) - 1
        units, code = np.unique(blanks * len(words) + at[ends], return_inverse=True)
        words = [" " * (u // len(words)) + words[u % len(words)] for u in units.tolist()]
        at, begin = code, np.searchsorted(ends, begin)
    return words, at, begin


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), then start[1], ..."""
    at = np.cumsum(size) - size
    return np.repeat(start - at, size) + np.arange(size.sum())


class Encoder:
    """Encodes texts by their distinct words; words' results are kept in a bounded memo."""

    def __init__(self, pieces: Pieces, n: int = 4):
        self.pieces, self.n = pieces, n
        self.memo = TwoGenerations(None)
        self.more = TwoGenerations(lambda w: pieces.n_best(" " + w, n), 30_000)

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[list[dict]]]]:
        """Ids of the texts' best segmentations one after another, where each text's begin, and for each text the scores of the
        n best ones and what each changes in the best: at, drop (ids from `at` on that go), ids (that come in their place).

        The lattice splits between units (`words`), so a distinct one is segmented once and its ids are copied to wherever it stands.
        """
        words, at, begin = distinct_words(texts)
        ids, scores, gaps = zip(*self.memo.many(words, lambda new: self.pieces.best_many([" " + w for w in new])), strict=True) if words else ((), (), ())
        flat, size = np.frombuffer(b"".join(ids), np.int32), np.array([len(x) >> 2 for x in ids], np.int64)
        scores, gaps = np.array(scores), np.array(gaps)
        sizes = size[at]
        out = flat[ranges((np.cumsum(size) - size)[at], sizes)]
        ends = np.r_[0, np.cumsum(sizes)]
        best, changes = [], []
        for a, b in itertools.pairwise(begin.tolist()):
            s, c = self.n_best(words, at[a:b], math.fsum(scores[at[a:b]].tolist()), gaps[at[a:b]], ids, ends[a : b + 1] - ends[a])
            best.append(s)
            changes.append(c)
        return out, ends[begin], best, changes

    def n_best(self, words: list[str], at: np.ndarray, best: float, near: np.ndarray, ids: tuple[bytes, ...], place: np.ndarray) -> tuple[list[float], list[list[dict]]]:
        """The n best segmentations of a text of the words `at`, whose second choices fall behind by `near`, and whose best ids
        begin at `place`: their scores and their changes.

        A text's segmentations are products of its words' ones. Only the n-1 words whose second choice is nearest can differ
        from their best among the n best, so the search over the whole lattice runs over these words' n-best lists.
        """
        k = min(self.n - 1, len(at))
        chosen = np.sort(np.argpartition(near, k - 1)[:k]) if 0 < k < len(at) else np.arange(k)
        chosen = chosen[np.isfinite(near[chosen])].tolist()
        lists = []
        for w in chosen:
            own, found = array("i", ids[at[w]]).tolist(), self.more[words[at[w]]]
            # the best one comes first, also among others of its score
            rest = [x for x in found if x[1] != own]
            lists.append([(found[0][0], own), *rest[: len(found) - 1]])
        behind = [[x[0][0] - s for s, _ in x] for x in lists]
        scores, changes = [], []
        heap, seen = [(0.0, (0,) * len(behind))], {(0,) * len(behind)}
        while heap and len(scores) < self.n:
            cost, ranks = heapq.heappop(heap)
            scores.append(best - cost)
            changes.append([{"at": int(place[w]), "drop": int(place[w + 1] - place[w]), "ids": x[r][1]} for w, x, r in zip(chosen, lists, ranks, strict=True) if r])
            for i, r in enumerate(ranks):
                if r + 1 < len(behind[i]) and (to := (*ranks[:i], r + 1, *ranks[i + 1 :])) not in seen:
                    seen.add(to)
                    heapq.heappush(heap, (cost - behind[i][r] + behind[i][r + 1], to))
        return scores, changes


@functools.lru_cache(maxsize=1)
def encoder(model: str, n: int) -> Encoder:
    """The encoder of this worker process: its vocabulary and memo serve one task after another."""
    return Encoder(Pieces(model), n)


@functools.lru_cache(maxsize=1)
def counter(model: str) -> TwoGenerations:
    """The memo of token counts of this worker process."""
    return TwoGenerations(TokenTrie(Pieces(model)).count)


CHANGES = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def encode(docs: DataFrame, text_col: str = "text", n: int = 4, model: str = MODEL, round_trip: bool = True) -> DataFrame:
    """docs with piece_ids array<int> (the best segmentation), nbest_scores array<double> (best first, at most n), nbest_changes
    (for each of these the words it segments otherwise: array of at, drop, ids; none for the best; n_best_ids() makes whole
    ones), and decoded_ok (whether decoding gives the text back; null unless round_trip).

    Null text counts as empty: one blank, so one piece. Every whole text is one lattice, however long; other columns pass
    through, nulls and repeated rows included, but for those of the new columns' names, which are replaced. An empty table
    gives no rows. The scores are -ln(rank + 2), because the public file is a BPE one and has no unigram scores.
    """
    from pyspark.sql import types as T

    names = ["piece_ids", "nbest_scores", "nbest_changes", "decoded_ok"]
    docs = docs.drop(*[x for x in names if x != text_col])
    change = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("drop", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    types = [T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType()), T.ArrayType(T.ArrayType(change)), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(*x) for x in zip(names, types, strict=True)]])

    def run(batches):
        made = encoder(model, n)
        for batch in batches:
            for rows, texts in sliced(batch, text_col):
                flat, offsets, scores, changes = made.many(texts)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                ok = pc.equal(made.pieces.spelling(flat, offsets), texts.cast(pa.large_binary())) if round_trip else pa.nulls(len(texts), pa.bool_())
                yield pa.RecordBatch.from_arrays([*rows.columns, ids, pa.array(scores, pa.list_(pa.float64())), pa.array(changes, CHANGES), ok], [*rows.schema.names, *names])

    return docs.mapInArrow(run, schema)


def n_best_ids():
    """Column of an encoded table: the ids of its n best segmentations, best first, array<array<int>>."""

    def spliced(changes):
        last_first = F.sort_array(changes, asc=False)  # the later ones first, so that the others' places hold
        return F.aggregate(last_first, F.col("piece_ids"), lambda ids, c: F.concat(F.slice(ids, 1, c["at"]), c["ids"], F.slice(ids, c["at"] + c["drop"] + 1, F.size(ids))))

    return F.transform("nbest_changes", spliced)


def decode(encoded: DataFrame, ids_col: str = "piece_ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """encoded with the text that its ids spell (in place of a column of that name); null ids give null."""
    from pyspark.sql import types as T

    encoded = encoded.drop(out_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        pieces = Pieces(model)
        for b in batches:
            texts = [None if x is None else pieces.decode(x) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, out_col])

    return encoded.mapInArrow(run, schema)


class TokenTrie:
    """Counts of the best segmentation for distinct pre-tokens: a trie whose nodes hold the unigram forward score of their
    prefix and the pieces it takes, each computed once, when the prefix first appears; a pre-token's count stands at its end.

    Nodes are (parent, character) -> node. Beyond `cap` nodes the trie starts anew: memory stays bounded, counts don't change.
    """

    def __init__(self, pieces: Pieces, cap: int = 400_000):
        self.pieces, self.cap = pieces, cap
        self.reset()

    def reset(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.taken = [0.0], [0]

    def count(self, word: str) -> int:
        """Pieces of the best segmentation of a blank and word."""
        word = " " + word
        if len(word) > TwoGenerations.LONGEST:  # a path of its own, which would fill the trie
            return len(self.pieces.best(word)[0]) >> 2
        if len(self.best) > self.cap:
            self.reset()
        child, best, taken, tail = self.child, self.best, self.taken, self.pieces.tail.get
        path, node = [0], 0
        for end in range(1, len(word) + 1):
            key = (node, word[end - 1])
            to = child.get(key)
            if to is None:
                start = end - 1  # starts go down, the leftmost wins a tie
                s = tail(word[start])
                lone = s is None or s == -math.inf
                size = len(word[start].encode("utf-8", "surrogatepass")) if lone else 1
                top, n = best[path[start]] + (size * self.pieces.byte_score if lone else s), taken[path[start]] + size
                start = start if s is not None else 0
                while start > 0:
                    start -= 1
                    s = tail(word[start:end])
                    if s is None:
                        break
                    s += best[path[start]]
                    if s >= top:
                        top, n = s, taken[path[start]] + 1
                to = len(best)
                best.append(top)
                taken.append(n)
                child[key] = to
            path.append(to)
            node = to
        return taken[node]


def count_tokens(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """docs with n_tokens and n_pretokens (longs): pre-tokens are what single blanks part, tokens the pieces of the
    text's best segmentation. Null text counts as empty: one pre-token, one token. Whole texts, however long; other columns
    pass through, but for those of the new columns' names, which are replaced; an empty table gives no rows."""
    from pyspark.sql import types as T

    docs = docs.drop(*{"n_tokens", "n_pretokens"} - {text_col})
    schema = T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("n_pretokens", T.LongType())])

    def run(batches):
        counts = counter(model)
        for batch in batches:
            for rows, texts in sliced(batch, text_col):
                words, at, begin = distinct_words(texts)
                total = np.r_[0, np.cumsum(np.array([counts[w] for w in words], np.int64)[at])][begin]
                parts = pc.add(pc.count_substring(texts, " ").cast(pa.int64()), 1)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(total)), parts], [*rows.schema.names, "n_tokens", "n_pretokens"])

    return docs.mapInArrow(run, schema)


def digest_columns(encoded: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids joined by commas), nbest_scores, nbest_sha256 (of the changes as JSON), decoded_ok."""
    ids = F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256)
    return encoded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), ids.alias("ids_sha256"), "nbest_scores", F.sha2(F.to_json("nbest_changes"), 256).alias("nbest_sha256"), "decoded_ok")
