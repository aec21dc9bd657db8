"""Ranked lexical search (operator 13) by dual-tree search.

Each task turns its documents into sparse vectors over the items' terms once; they are stored. The score of a pair is a
sum over shared terms of an item's coordinate (the term's weight) times a document's (what its frequency is worth), both
0 or more. A task builds a hierarchy over a block of documents and there is one over the items; a node holds the maxima
of its members' coordinates, so that the product of two nodes is a bound for all pairs below them. The two are descended
together, and a pair of nodes goes as soon as its bound is less than the weakest k-th score of the items below: an equal
score could still win by its doc_id, so nothing is lost. What is left at the bottom is scored in full. All numbers are
integers below 2^53 in doubles, so bounds and scores are exact.

Items are taken in blocks of about ITEM_BYTES of text; the terms and the hierarchy of one block are broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut
from .words import words

#: Bytes of items' texts in a block, about.
ITEM_BYTES = 4 << 20
#: Documents of a hierarchy; children of a node of documents, and of items.
BLOCK, FAN, ITEM_FAN = 4096, 16, 4
#: Documents' digits behind their ids where doc_id is null: they come last among equals.
LAST = (1 << 63) - 1


@dataclass
class Vocabulary:
    """The items of a block, sorted by id and text, and their terms' numbers."""

    ids: list[int | None]
    terms: list[np.ndarray]
    number: dict[bytes, int]

    @staticmethod
    def of(rows: Iterable[tuple[int | None, bytes | None]]) -> Vocabulary:
        number: dict[bytes, int] = {}
        ids, terms = [], []
        for item_id, raw in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or b"")):
            ids.append(item_id)
            terms.append(np.array([number.setdefault(w, len(number)) for w in dict.fromkeys(words(raw))], np.int64))
        return Vocabulary(ids, terms, number)


def vectors(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """(doc_id, n, term, tf) for each row of docs: all terms with repeats, and those that items have, with frequencies."""
    spread = docs.sparkSession.sparkContext.broadcast(known.number)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = spread.value
        for batch in batches:
            n, term, tf = [], [], []
            for raw in batch.column(1).to_pylist():
                own = words(raw)
                held = {number[w]: c for w, c in Counter(own).items() if w in number}
                n.append(len(own))
                term.append(list(held))
                tf.append(list(held.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip((n, term, tf), list(schema)[1:], strict=True))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


@dataclass
class Rows:
    """Sparse rows of coordinates: where each row's entries start (and the last end), their terms, their values."""

    starts: np.ndarray
    term: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        sizes = [len(t) for t, _ in rows]
        return Rows(np.cumsum([0, *sizes]), np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]).astype(float))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.starts[k], self.starts[k + 1])
        return self.term[own], self.value[own]

    def take(self, rows: np.ndarray) -> Rows:
        if len(rows) == len(self):
            return self
        begin, size = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        starts = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(begin - starts[:-1], size) + np.arange(starts[-1])
        return Rows(starts, self.term[at], self.value[at])

    def maxima(self, fan: int) -> Rows:
        """Rows of the maxima of each ``fan`` rows."""
        row = np.repeat(np.arange(len(self)) // fan, np.diff(self.starts))
        order = np.lexsort((self.term, row))
        row, term, value = row[order], self.term[order], self.value[order]
        first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(term, prepend=-1) != 0))
        sizes = np.bincount(row[first], minlength=-(-len(self) // fan))
        return Rows(np.concatenate(([0], np.cumsum(sizes))), term[first], np.maximum.reduceat(value, first))


def hierarchy(low: Rows, fan: int) -> list[Rows]:
    """Levels of nodes, the given rows first: a node of a level has the maxima of ``fan`` of the one below; the last has
    one node. No row may be empty."""
    levels = [low]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].maxima(fan))
    return levels


def _alike(rows: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> list[int]:
    """An order of rows that keeps those together whose two rarest terms are the same."""
    rarest = [t[np.lexsort((t, -weight[t]))[:2]].tolist() for t, _ in rows]
    return sorted(range(len(rows)), key=rarest.__getitem__)


class Items:
    """Items of a block that have terms, alike ones together, and their hierarchy."""

    def __init__(self, known: Vocabulary, weight: np.ndarray):
        having = [(k, (t, weight[t])) for k, t in enumerate(known.terms) if len(t)]
        order = _alike([r for _, r in having], weight)
        self.number = [having[k][0] for k in order]
        self.weight = weight.astype(float)
        self.levels = hierarchy(Rows.of([having[k][1] for k in order]), ITEM_FAN)

    def below(self, nodes: np.ndarray, depth: int) -> np.ndarray:
        """The children of nodes of a level."""
        own = (nodes[:, None] * ITEM_FAN + np.arange(ITEM_FAN)).ravel()
        return own[own < len(self.levels[depth - 1])]


class Search:
    """The k best documents of each item among those seen, by falling score and rising id."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in items.number]
        #: By level: the weakest k-th score of the items below a node; a score must be above 0 in any case.
        self.weakest = [np.ones(len(level)) for level in items.levels]
        self.node = np.zeros(len(items.weight))  # coordinates of one node of documents
        self.place = np.zeros(len(items.weight), np.int64)
        self.scored = 0

    def see(self, ids: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Search a block of documents: their ids (LAST: none), and their terms (one at least) with coordinates."""
        order = _alike(rows, self.items.weight)
        self.ids, self.levels = ids[order], hierarchy(Rows.of([rows[k] for k in order]), FAN)
        for item in [k for k, best in enumerate(self.best) if len(best) < self.k]:
            self._probe(item)
        self._raise(np.arange(len(self.best)))
        self._visit(len(self.levels) - 1, 0, len(self.items.levels) - 1, np.array([0]))

    def _probe(self, item: int) -> None:
        """Go straight down to the documents that promise an item most: k of them are a first k-th score. They are not
        kept, as the search comes by again."""
        term, value = self.items.levels[0].row(item)
        self.node[term] = value
        nodes = np.array([0])
        for level in range(len(self.levels) - 1, -1, -1):
            own = self.levels[level].take(nodes)
            bound = np.add.reduceat(own.value * self.node[own.term], own.starts[:-1])
            if level:
                top = nodes[bound.argmax()]
                nodes = np.arange(top * FAN, min((top + 1) * FAN, len(self.levels[level - 1])))
        self.node[term] = 0
        if len(bound) >= self.k:
            self.weakest[0][item] = max(self.weakest[0][item], np.sort(bound)[-self.k])

    def _raise(self, items: np.ndarray) -> None:
        """Hand the k-th scores of items up to the nodes above."""
        nodes = items
        for depth in range(1, len(self.weakest)):
            nodes = np.unique(nodes // ITEM_FAN)
            for node in nodes:
                self.weakest[depth][node] = self.weakest[depth - 1][node * ITEM_FAN : (node + 1) * ITEM_FAN].min()

    def _visit(self, level: int, node: int, depth: int, alive: np.ndarray) -> None:
        """A node of documents against nodes of items of one depth; what cannot be pruned goes on with the children on
        both sides, the items' side first where it is the higher one."""
        term, value = self.levels[level].row(node)
        while True:
            nodes = self.items.levels[depth].take(alive)
            self.node[term] = value
            bound = np.add.reduceat(nodes.value * self.node[nodes.term], nodes.starts[:-1])
            self.node[term] = 0
            alive = alive[bound >= self.weakest[depth][alive]]
            if not len(alive):
                return
            if not depth or (level > 1 and depth < level):
                break
            alive, depth = self.items.below(alive, depth), depth - 1
        if level > 1:
            children = np.arange(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1])))
            own = self.levels[level - 1].take(children)
            reach = np.add.reduceat(own.value * self.items.weight[own.term], own.starts[:-1])
            for child in children[np.argsort(-reach, kind="stable")]:  # the most promising first
                self._visit(level - 1, child, depth, alive)
        else:
            self._score(node * FAN if level else node, FAN if level else 1, term, alive)

    def _score(self, first: int, size: int, term: np.ndarray, alive: np.ndarray) -> None:
        """Score the documents of a lowest node, which have no other terms, with items in full."""
        own = self.levels[0].take(np.arange(first, min(first + size, len(self.levels[0]))))
        self.place[term] = np.arange(1, len(term) + 1)
        docs = np.zeros((len(own), len(term) + 1))
        docs[np.repeat(np.arange(len(own)), np.diff(own.starts)), self.place[own.term]] = own.value
        items = self.items.levels[0].take(alive)
        scores = np.add.reduceat(docs[:, self.place[items.term]] * items.value, items.starts[:-1], axis=1)
        self.place[term] = 0
        self.scored += scores.size
        changed = []
        for column in np.flatnonzero((scores >= self.weakest[0][alive]).any(axis=0)):
            item = alive[column]
            best = self.best[item]
            best += [(-int(s), int(i)) for s, i in zip(scores[:, column], self.ids[first : first + size], strict=True) if s >= self.weakest[0][item]]
            best.sort()
            del best[self.k :]
            if len(best) == self.k and -best[-1][0] > self.weakest[0][item]:
                self.weakest[0][item] = -best[-1][0]
                changed.append(item)
        self._raise(np.array(changed, np.int64))


def coordinates(tf: np.ndarray, n: int, documents: int, length: int, scale: int) -> np.ndarray:
    """What frequencies are worth in a document of n terms: (10^9 tf) div (1000 tf + 8 m)."""
    m = 100 - scale + (scale * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _block(docs: DataFrame, known: Vocabulary, k: int, scale: int) -> DataFrame:
    """(item, doc_id, score): for each item of a block by number its k best rows of docs of each task."""
    spark = docs.sparkSession
    stored = cut(vectors(docs, known))
    held = stored.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(known.number), np.int64)
    for row in stored.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # terms of a block
        df[row.term] = row.df
    weight = np.array([math.floor(1000 * math.log((2 * held.documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    spread = spark.sparkContext.broadcast(Items(known, weight))
    documents, length = held.documents, held.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(spread.value, k)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                ids = np.array([LAST if i is None else i for i in batch.column(0).to_pylist()], np.int64)
                rows = [(np.array(t, np.int64), coordinates(np.array(f, np.int64), n, documents, length, scale)) for n, t, f in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
                search.see(ids, rows)
        found = [(int(item), i, -s) for item, own in zip(spread.value.number, search.best, strict=True) for s, i in own]
        columns = list(zip(*found, strict=True)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return stored.filter(F.size("term") > 0).mapInArrow(run, "item long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, scale: int = 90) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items (item_id, text) the k rows of docs (doc_id, text) of the
    highest scores above 0, equal ones by rising doc_id; more columns are ignored. Null and empty texts have no term:
    such an item has no row, such a document is in none and does not count into N. A null doc_id comes last among equals
    and is returned as null; rows that repeat a doc_id are documents of their own, those that repeat an item are ranked
    each, and have their ranks one after the other. Empty tables give an empty result."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // ITEM_BYTES))
    parts = []
    for block in range(blocks):  # of the stated query set
        known = Vocabulary.of((r.item_id, bytes(r.text) if r.text is not None else None) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect())
        if not known.number:
            continue
        best = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
        found = _block(docs, known, k, scale).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = docs.sparkSession.createDataFrame(list(enumerate(known.ids)), "item long, item_id long")
        parts.append(found.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "score"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)


#: The same in DuckDB.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
len AS (SELECT doc_id, count(*)::BIGINT AS n FROM d GROUP BY doc_id),
all_ AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM len),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, all_ GROUP BY term, docs),
c AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // l))) AS part FROM tf JOIN len USING (doc_id) JOIN w USING (term), all_),
s AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM i JOIN c USING (term) GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
