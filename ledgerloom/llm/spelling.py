"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

1. Runs of letters are lower-cased, some lose a letter by the contract's rule, and words are counted by Spark's own functions,
   summed before the shuffle.
2. A word is a point: how often it has each letter (a to z, and six classes of the other letters; at most 255). One edit moves a
   point by at most one up and one down, so its L1 distance is at most two: a replaced letter stays on the points of its own
   length, an inserted one goes one up to the points of the next length, a deleted one goes one down.
3. For each length a k-d tree is cut from a bounded sample (``SAMPLE`` words of the whole vocabulary). It decides only which cell
   a point lies in, so results do not depend on it. Points go to their cell; a word is searched in every cell whose box those
   moves reach (all boxes are pruned at once), for each of the three pairs of lengths. A cell over ``CELL`` points is dealt into blocks.
4. A task reads the points of a block first and cuts them into a tree of its own, with the tight box of each node; the words to
   look up then stream past. Where a leaf's box is reached, points are compared, then letters in order. Each word and block sends
   one row: near words, and the best of them.
5. Forms are followed to their root by pointer doubling; each form has twice the count of its word, so chains are short.

Defined cases: null or empty text has no words; a null doc_id counts as the empty id in the deletion rule; repeated rows count again;
equal counts take the word that is smaller in code-point order; words of any length take part; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sqltext import lower_ascii
from .store import bound_batches, keep, small
from .textkit import expand

MIN_POINTS, MIN_COUNT, DELETE_ONE_IN, FORM_FACTOR = 5, 3, 97, 2
#: Words that the cells' trees are cut from; points of a block; points of a leaf of a block's own tree.
SAMPLE, CELL, LEAF = 200_000, 8_192, 24
#: Letters of words that a block holds, and letters that are compared at once.
CELL_LETTERS, AT_ONCE = 1 << 22, 1 << 22
DIMS = 32
#: Of the searched length less the word's own: how far one edit goes up and down.
MOVES = {0: (1, 1), 1: (1, 0), -1: (0, 1)}

_DIM = np.zeros(256, np.int64)
_DIM[97:123] = np.arange(26)
_DIM[192:256] = 26 + np.arange(64) % 6


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters after the deletion rule, of at least ``MIN_POINTS`` code points."""
    text = lower_ascii(F.coalesce("text", F.lit("")))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.split(text, "[^a-z\\u00C0-\\u00FF]+")).alias("run")).where(F.length("run") >= MIN_POINTS)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.pmod("h", F.lit(DELETE_ONE_IN)) == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= MIN_POINTS).groupBy("word").agg(F.count("*").alias("n"))


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (Latin-1) as letters one after the other with bounds, and their points."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    at = np.append(0, np.cumsum([len(w) for w in words]))
    flat = np.bincount(np.repeat(np.arange(len(words)), np.diff(at)) * DIMS + _DIM[raw], minlength=len(words) * DIMS)
    return raw, at, np.minimum(flat, 255).astype(np.int16).reshape(-1, DIMS)


def _halves(points: np.ndarray) -> tuple[int, int] | None:
    """The letter and the count (at most: left) that cut ``points`` most evenly; none where all are equal."""
    best, n = (0, 0, 0), len(points)
    for d in np.argsort(-points.var(0), kind="stable")[:6]:
        upto = np.cumsum(np.bincount(points[:, d]))[:-1]
        if len(upto):
            t = int(np.argmin(np.abs(2 * upto - n)))
            best = max(best, (int(min(upto[t], n - upto[t])), int(d), t), key=lambda x: x[0])
    return best[1:] if best[0] else None


class Tree:
    """A k-d tree: children (-1: a leaf), boxes ``low`` to ``high`` of the nodes, and the rows below each leaf."""

    def __init__(self, points: np.ndarray, leaf: float, tight: bool):
        """Nodes of over ``leaf`` points are cut. Boxes are those of the points (``tight``), or of the cuts alone."""
        self.dim, self.cut, self.left, self.right, low, high, self.rows = [], [], [], [], [], [], []
        todo = [(np.arange(len(points)), np.zeros(DIMS, np.int16), np.full(DIMS, 255, np.int16), -1, False)]
        while todo:
            rows, lo, hi, parent, is_right = todo.pop()
            node, own = len(self.dim), points[rows]
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            if tight:
                lo, hi = own.min(0), own.max(0)
            by = _halves(own) if len(rows) > leaf else None
            d, t = by or (-1, -1)
            for store, x in ((self.dim, d), (self.cut, t), (self.left, -1), (self.right, -1), (low, lo), (high, hi), (self.rows, rows if by is None else None)):
                store.append(x)
            if by:
                mid, over = hi.copy(), lo.copy()
                mid[d], over[d] = t, t + 1
                less = own[:, d] <= t
                todo += [(rows[less], lo, mid, node, False), (rows[~less], over, hi, node, True)]
        self.low, self.high = np.array(low), np.array(high)
        self.dim, self.cut, self.left, self.right = (np.array(x, np.int64) for x in (self.dim, self.cut, self.left, self.right))

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls in."""
        node = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.left[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            node[inner] = np.where(points[inner, self.dim[at]] <= self.cut[at], self.left[at], self.right[at])

    def reach(self, points: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) where a leaf's box can be reached by at most ``up`` steps up and ``down`` steps down."""
        who, node, out = np.arange(len(points)), np.zeros(len(points), np.int64), []
        while len(who):
            own = points[who]
            near = (np.maximum(self.low[node] - own, 0).sum(1) <= up) & (np.maximum(own - self.high[node], 0).sum(1) <= down)
            who, node = who[near], node[near]
            leaf = self.left[node] < 0
            out.append((who[leaf], node[leaf]))
            who, node = who[~leaf], node[~leaf]
            who, node = np.concatenate([who, who]), np.concatenate([self.left[node], self.right[node]])
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def one_edit(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: int, more: int) -> np.ndarray:
    """Whether words a[a_at[i]:][:size] and b[b_at[i]:][:size + more] differ by exactly one replaced (``more`` 0) or inserted letter."""
    step = np.arange(size)
    x, y = a[a_at[:, None] + step], b[b_at[:, None] + step]
    if not more:
        return (x != y).sum(1) == 1
    tail = b[b_at[:, None] + step + 1]
    head = np.where((x != y).any(1), (x != y).argmax(1), size)  # letters that agree from the front
    differ = x != tail
    last = np.where(differ.any(1), size - differ[:, ::-1].argmax(1), 0)  # from here on letters agree from the back
    return head >= last


class Block:
    """Points of one length, ready to be searched."""

    def __init__(self, words: list[bytes], n: list[int]):
        self.words, self.n = words, np.array(n, np.int64)
        self.size = len(words[0])
        self.raw, self.at, self.points = letters(words)
        self.rank = np.argsort(np.argsort(np.array(words, object), kind="stable"), kind="stable")
        self.tree = Tree(self.points, LEAF, True)
        sizes = np.array([0 if r is None else len(r) for r in self.tree.rows], np.int64)
        self.leaf_size, self.leaf_at = sizes, np.cumsum(sizes) - sizes
        self.members = np.concatenate([r for r in self.tree.rows if r is not None])

    def search(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words of one length: how many near points each has, and the best of them (its row, -1 if none) by count, then order."""
        found, best = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        raw, at, points = letters(words)
        more = self.size - len(words[0])
        up, down = MOVES[more]
        who, leaf = self.tree.reach(points, up, down)
        upto = np.cumsum(self.leaf_size[leaf]) // max(1, AT_ONCE // max(DIMS, self.size))
        cuts = np.append(0, np.flatnonzero(np.diff(upto)) + 1).tolist() if len(who) else []
        for a, b in zip(cuts, [*cuts[1:], len(who)], strict=True) if cuts else ():
            w, f = who[a:b], leaf[a:b]
            q, p = np.repeat(w, self.leaf_size[f]), self.members[expand(self.leaf_at[f], self.leaf_size[f])]
            step = self.points[p] - points[q]
            near = (np.maximum(step, 0).sum(1) <= up) & (np.maximum(-step, 0).sum(1) <= down)
            q, p = q[near], p[near]
            if more >= 0:
                same = one_edit(raw, at[q], self.raw, self.at[p], len(words[0]), more)
            else:
                same = one_edit(self.raw, self.at[p], raw, at[q], self.size, 1)
            q, p = q[same], p[same]
            found += np.bincount(q, minlength=len(words))
            for i, j in zip(q.tolist(), p.tolist(), strict=True):
                b = best[i]
                if b < 0 or (self.n[j], -self.rank[j]) > (self.n[b], -self.rank[b]):
                    best[i] = j
        return found, best, self.n


ROUTED = "size int, cell int, search boolean, word string, n long"


def _routed(trees: dict[int, Tree]):
    """Each word as a point of its cell, and as a search in every cell that it reaches; lengths without a tree are one cell."""
    schema = pa.schema([("size", pa.int32()), ("cell", pa.int32()), ("search", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0), batch.column(1)
            sizes = np.array([len(w) for w in words.to_pylist()], np.int64)
            for own in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == own)
                _, _, points = letters([w.encode("latin-1") for w in words.take(pa.array(rows)).to_pylist()])
                for more, (up, down) in MOVES.items():
                    tree = trees.get(own + more)
                    if own + more < MIN_POINTS:
                        continue
                    parts = [(np.arange(len(rows)), np.zeros(len(rows), np.int64)) if tree is None else tree.reach(points, up, down)]
                    if not more:
                        parts.append((np.arange(len(rows)), np.zeros(len(rows), np.int64) if tree is None else tree.place(points)))
                    for (who, cell), search in zip(parts, (True, False), strict=False):
                        at = pa.array(rows[who])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), own + more, np.int32)), pa.array(cell.astype(np.int32)), pa.array(np.full(len(who), search)), words.take(at), n.take(at)], schema=schema)

    return task


FOUND = "word string, near long, best_n long, best string"


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block, points first: near words of every searched word within the block."""
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    key, words, counts, block = None, [], [], None
    for batch in batches:
        names = batch.schema.names
        size, cell, block_no, search = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("size", "cell", "block", "search"))
        text, n = batch.column(names.index("word")), batch.column(names.index("n"))
        change = np.flatnonzero((np.diff(size) != 0) | (np.diff(cell) != 0) | (np.diff(block_no) != 0) | (np.diff(search.astype(np.int8)) != 0)) + 1
        for a, b in zip(np.append(0, change).tolist(), np.append(change, len(size)).tolist(), strict=True):
            if a == b:
                continue
            if (size[a], cell[a], block_no[a]) != key:
                key, words, counts, block = (size[a], cell[a], block_no[a]), [], [], None
            mine = [w.encode("latin-1") for w in text.slice(a, b - a).to_pylist()]
            if not search[a]:
                words += mine
                counts += n.slice(a, b - a).to_pylist()
                continue
            if not words:
                continue
            block = block or Block(words, counts)
            length = np.array([len(w) for w in mine])
            for own in np.unique(length).tolist():
                part = [w for w in mine if len(w) == own]
                near, best, weight = block.search(part)
                hit = np.flatnonzero(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[i].decode("latin-1") for i in hit], pa.string()), pa.array(near[hit]), pa.array(weight[best[hit]]), pa.array([block.words[j].decode("latin-1") for j in best[hit]], pa.string())], schema=schema
                )


def _trees(words: DataFrame, cell: int, sample: int) -> dict[int, Tree]:
    """A tree for each length of over ``cell`` words, cut from ``sample`` words of all lengths."""
    sizes = {r["size"]: r["words"] for r in words.groupBy("size").agg(F.count("*").alias("words")).collect()}  # one row a length
    total = sum(sizes.values())
    large = [s for s, n in sizes.items() if n > cell or n * s > CELL_LETTERS]
    part = min(1.0, sample / max(1, total))
    taken: dict[int, list[bytes]] = {s: [] for s in large}
    chosen = words.where(F.col("size").isin(large) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1))
    for r in chosen.select("word").collect():  # about ``sample`` words
        taken[len(r["word"])].append(r["word"].encode("latin-1"))
    trees = {s: Tree(letters(own)[2], max(1.0, min(cell, CELL_LETTERS / s) * len(own) / sizes[s]), False) for s, own in taken.items() if own}
    for t in trees.values():
        t.rows = []  # the sample itself is not sent
    return trees


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, n_near, best_n, best of the words (word, n) that have near ones."""
    bound_batches(words.sparkSession)
    words = words.withColumn("size", F.length("word"))
    routed = keep(words.select("word", "n").mapInArrow(_routed(_trees(words, cell, sample)), ROUTED))
    held = F.ceil(F.greatest(F.col("points") / cell, F.col("points") * F.col("size") / CELL_LETTERS)).cast("int")
    full = keep(routed.where("not search").groupBy("size", "cell").agg(F.count("*").alias("points")).select("size", "cell", held.alias("blocks")).where("blocks > 1"))
    dealt = routed.join(small(full), ["size", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    block = F.explode(F.when(F.col("search"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)).alias("block")
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.select("size", "cell", block, "search", "word", "n").repartition(parts, "size", "cell", "block").sortWithinPartitions("size", "cell", "block", "search")
    found = rows.mapInArrow(_searched, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form (word, form), by pointer doubling."""
    now = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = keep(now.join(small(keep(on)), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return now
        now = step.select("word", "root")


def spelling_variants(docs: DataFrame, least: int = MIN_COUNT, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word that occurs ``least`` times or more."""
    words = keep(counted_words(docs).where(F.col("n") >= least))
    near = near_words(words, cell, sample)
    whole = F.col("best_n") >= FORM_FACTOR * F.col("n")
    judged = keep(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(whole, F.col("best")).alias("form"), F.when(whole, F.col("best_n")).alias("form_n")))
    top = roots(judged.where("form is not null"))
    return judged.join(top, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
