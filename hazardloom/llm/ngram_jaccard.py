"""N-gram Jaccard join by a token-group matrix.

1. Every text becomes the set of its distinct word n-grams (64-bit hashes); equal sets are one class.
2. The n-grams' counts meet by hash range (:mod:`blobs`): an n-gram of one class alone can lie in no
   intersection, so a class with too many of them links with nothing and goes no further.
3. The other classes are sorted by commonest token and min-hashes, so similar ones are neighbours, and cut
   into groups of bounded size. Two tables are written: the groups' members, and the matrix, whose row is the
   union of a group's tokens. Groups meet on the rarest tokens of their members, of which any linked pair shares one.
4. The members of one group are queries to the other's matrix row: a query's overlap with the union bounds its
   similarity with all members. Only queries that the bound lets through go on to the group's members, which are
   fetched for them alone and compared exactly.
5. Links between class representatives give components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import BATCH_BITS, SLICE_BYTES, bucket_count, bucket_edges, first_of_runs, pack_sorted, segments, small_batches, unpack_sorted
from .common import cut, numbered, shuffle_width
from .components import components
from .text_arrays import ascii_lower, mix, spaces, text_bytes, text_slices, window_hashes, window_rows, word_hashes, word_spans

ROWS = 1 << BATCH_BITS
#: members and tokens that one group holds at most (a longer set is a group of its own)
GROUP_MEMBERS, GROUP_TOKENS = 128, 1 << 16
#: a token in more sets than this goes last in the token order, if it is among the commonest ``COMMON_MOST``
COMMON_OVER, COMMON_MOST = 32, 1 << 18
#: a class with more than this part of the rows is joined by broadcast
HOT_CLASSES = 1000
_SALT = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, offsets of the texts in them)."""
    flat, offsets = text_bytes(texts)
    flat = ascii_lower(flat)
    starts, ends, bounds = word_spans(~spaces(flat), offsets)
    words, n_words, n = word_hashes(flat, starts, ends), np.diff(bounds), len(starts)
    row_of = np.repeat(np.arange(len(texts)), n_words)
    at = np.flatnonzero(window_rows(bounds, width, n))
    hashes, rows = [window_hashes(words, width)[at]], [row_of[at]]
    for short in range(1, width):  # the whole of a shorter text
        mine = np.flatnonzero(n_words == short)
        if len(mine):
            hashes.append(mix(window_hashes(words, short)[bounds[mine]] + np.uint64(short)))
            rows.append(mine)
    token, row = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    first = np.ones(len(token), bool)
    first[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, row = token[first], row[first]
    return token, np.searchsorted(row, np.arange(len(texts) + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


SENT = "bucket int, batch long, keys binary, who binary, digests binary, rid binary, n binary, d1 binary, d2 binary"
FACTS = "rid long, n long, d1 long, d2 long, alone long"


def _send_tokens(width: int, buckets: int):
    types = (pa.int32(), pa.int64(), *[pa.binary()] * 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in segments(batches, 0, 1):
            rids = part.column(0).to_numpy()
            token, at = shingle_sets(part.column(1), width)
            d1, d2 = _sums(mix(token), at), _sums(mix(token ^ _SALT), at)
            rows: list[list] = [[x] for x in (-1, batch, b"", b"", b"", rids.tobytes(), np.diff(at).astype(np.int64).tobytes(), d1.tobytes(), d2.tobytes())]
            row = np.repeat(np.arange(len(rids)), np.diff(at))
            order = np.argsort(token, kind="stable")
            token, row = token[order], row[order]
            if len(token):
                first = np.flatnonzero(first_of_runs(token))
                digest = d1[row]
                shared = np.minimum.reduceat(digest, first) != np.maximum.reduceat(digest, first)
                token, row = token[first], row[first]
                edges = bucket_edges(token, buckets)
                local = (rids & (ROWS - 1)).astype(np.uint8)
                for b in np.flatnonzero(np.diff(edges)):
                    x = slice(edges[b], edges[b + 1])
                    used, who = np.unique(row[x], return_inverse=True)
                    values = (int(b), batch, pack_sorted(token[x]), local[used][who].tobytes() + np.packbits(shared[x]).tobytes(), local[used].tobytes() + d1[used].tobytes(), b"", b"", b"", b"")
                    for column, value in zip(rows, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=[f.split()[0] for f in SENT.split(", ")])

    return run


def _count_alone(table: pa.Table) -> pa.Table:
    """For each blob: how many tokens of each of its rows no other class has."""
    names = ["batch", "alone", "rid", "n", "d1", "d2"]
    if table.column("bucket")[0].as_py() < 0:
        return table.append_column("alone", pa.array([b""] * table.num_rows, pa.binary())).select(names)
    keys, digests, rows, flags, sizes = [], [], [], [], []
    for k, w, d in zip(*(table.column(c).to_pylist() for c in ("keys", "who", "digests"))):
        key = unpack_sorted(k)
        n, used = len(key), len(d) // 9
        of = np.zeros(ROWS, np.uint64)
        of[np.frombuffer(d, np.uint8, used)] = np.frombuffer(d, np.uint64, used, used) if used % 8 == 0 else np.frombuffer(d[used:], np.uint64)
        who = np.frombuffer(w, np.uint8, n)
        keys.append(key)
        rows.append(who)
        digests.append(of[who])
        flags.append(np.unpackbits(np.frombuffer(w, np.uint8, offset=n), count=n).astype(bool))
        sizes.append(n)
    key, digest, flag = np.concatenate(keys), np.concatenate(digests), np.concatenate(flags)
    del keys, digests, flags
    order = np.argsort(key)
    first = np.flatnonzero(first_of_runs(key[order]))
    digest = digest[order]
    shared = (np.minimum.reduceat(digest, first) != np.maximum.reduceat(digest, first)) | np.logical_or.reduceat(flag[order], first)
    alone = np.empty(len(key), bool)
    alone[order] = np.repeat(~shared, np.diff(np.append(first, len(key))))
    ends = np.cumsum(sizes)
    counts = [np.bincount(w[alone[z - len(w) : z]], minlength=ROWS).astype(np.uint32) for w, z in zip(rows, ends)]
    none = pa.array([b""] * len(counts), pa.binary())
    return pa.table([table.column("batch"), pa.array([c.tobytes() for c in counts], pa.binary()), none, none, none, none], names=names)


def _facts(table: pa.Table) -> pa.Table:
    alone = np.zeros(ROWS, np.int64)
    for x in table.column("alone").to_pylist():
        if x:
            alone += np.frombuffer(x, np.uint32)
    rid, n, d1, d2 = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("rid", "n", "d1", "d2"))
    return pa.table({"rid": rid, "n": n, "d1": d1, "d2": d2, "alone": alone[rid & (ROWS - 1)]})


def set_classes(docs: DataFrame, width: int) -> DataFrame:
    """(rid, n, d1, d2, alone) for each row (rid, text): set size, 128-bit digest and a bound on tokens of its own.

    Of the rows of a class in one batch only the first is charged with the class's own tokens: take the largest.
    """
    small_batches(docs.sparkSession)
    buckets = -(-3 * bucket_count(docs, "text") // 2)  # an entry here also holds its class's digest
    sent = docs.mapInArrow(_send_tokens(width, buckets), SENT)
    known = sent.withColumn("bucket", F.when(F.col("bucket") < 0, -1 - F.pmod("batch", F.lit(buckets))).otherwise(F.col("bucket")))
    answers = known.groupBy("bucket").applyInArrow(_count_alone, "batch long, alone binary, rid binary, n binary, d1 binary, d2 binary")
    return answers.groupBy("batch").applyInArrow(_facts, FACTS)


def _token_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in text_slices(batch.column(1), SLICE_BYTES):
                token, at = shingle_sets(batch.column(1).slice(a, z - a), width)
                low = [np.minimum.reduceat(mix(token ^ np.uint64(s)), at[:-1]) for s in (11, 12)]  # no set here is empty
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(token.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(np.diff(at)), *[pa.array(x.view(np.int64)) for x in low], lists], names=["rep", "n", "h1", "h2", "tokens"])

    return run


def _ranks(common, tokens: np.ndarray) -> np.ndarray:
    """Place of tokens in the common order: their count if they are among the commonest, else 0."""
    names, counts = common
    if not len(names):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
    return np.where(names[at] == tokens, counts[at], 0)


def _with_commonest(common):
    """Add to each set its commonest token (0 where none is common): large clusters of similar sets share it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, at = _flat(batch.column(batch.schema.get_field_index("tokens")))
            rank, row = _ranks(common.value, token), np.repeat(np.arange(batch.num_rows), np.diff(at))
            first = np.lexsort((np.arange(len(token)), -rank, row))[at[:-1]]  # no set is empty
            tops = np.where(rank[first] > 0, token[first].view(np.int64), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.int64())], names=[*batch.schema.names, "top"])

    return run


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy()[at[0] : at[-1]].view(np.uint64), at - at[0]


def _prefix(n: int, percent: int) -> int:
    """How many first tokens of a set of ``n``, in any one order, meet those of every linked set."""
    return n - -(-percent * n // 100) + 1


GROUPS = "gid long, reps binary, sizes binary, tokens binary, matrix binary, keys array<long>, least long, most long"


def _grouped(percent: int, common):
    """Cut sorted sets into groups: members (reps, sizes, tokens), the matrix row (their union), index tokens and size range."""

    def emit(members: list) -> list:
        reps = np.array([r for r, _ in members], np.int64)
        sizes = np.array([len(t) for _, t in members], np.int64)
        token, row = np.concatenate([t for _, t in members]), np.repeat(np.arange(len(members)), sizes)
        place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rarest = token[np.lexsort((token, _ranks(common.value, token), row))]  # of each set, the commonest last
        keys = np.unique(rarest[place < np.repeat([_prefix(int(n), percent) for n in sizes], sizes)])
        return [int(reps[0]), reps.tobytes(), sizes.tobytes(), token.tobytes(), np.unique(token).tobytes(), keys.view(np.int64), int(sizes.min()), int(sizes.max())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, held, last = [], 0, None
        types = (pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.int64(), pa.int64())
        names = [f.split()[0] for f in GROUPS.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in types]
            every, at = _flat(batch.column(3))
            for i, rep, h1, top in zip(range(batch.num_rows), batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                token, key = every[at[i] : at[i + 1]].copy(), (top, h1)
                # alike: the same min-hash, or the same commonest token and half of the group's first set
                alike = members and (key == last or (top and top == last[0] and 2 * len(np.intersect1d(members[0][1], token, assume_unique=True)) >= max(len(members[0][1]), len(token))))
                if members and (not alike or len(members) == GROUP_MEMBERS or held + len(token) > GROUP_TOKENS):
                    for column, value in zip(out, emit(members)):
                        column.append(value)
                    members, held = [], 0
                members.append((rep, token))
                held, last = held + len(token), key
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(emit(members), types)], names=names)

    return run


def through_bound(percent: int, sizes: np.ndarray, tokens: np.ndarray, union: np.ndarray, least: int) -> np.ndarray:
    """Which query sets may link with a set of at least ``least`` tokens within the sorted ``union``."""
    at = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
    total = np.concatenate([[0], np.cumsum(union[at] == tokens)])
    ends = np.cumsum(sizes)
    return (100 + percent) * (total[ends] - total[ends - sizes]) >= percent * (sizes + least)


def open_groups(percent: int, left: tuple, right: tuple | None, every: bool = False) -> list[tuple[int, int]]:
    """Links between members of two groups (or within one), each (reps, sizes, tokens): a spanning forest of them, or ``every`` one."""
    (reps, sizes, tokens), same = left, right is None
    other_reps, other_sizes, other_tokens = left if same else right
    other_rows = np.repeat(np.arange(len(other_reps)), other_sizes)
    order = np.argsort(other_tokens, kind="stable")
    column, column_rows = other_tokens[order], other_rows[order]
    links, parent = [], {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    ends = np.cumsum(sizes)
    for q in range(len(reps)):
        mine = tokens[ends[q] - sizes[q] : ends[q]]
        first, last = np.searchsorted(column, mine), np.searchsorted(column, mine, side="right")
        spans = last - first
        hits = column_rows[np.repeat(last - np.cumsum(spans), spans) + np.arange(spans.sum())]
        both = np.bincount(hits, minlength=len(other_reps))
        linked = np.flatnonzero((100 + percent) * both >= percent * (sizes[q] + other_sizes))
        for d in linked[linked > q] if same else linked:
            a, b = find(int(reps[q])), find(int(other_reps[d]))
            if every or a != b:
                parent[max(a, b)] = min(a, b)
                links.append((int(reps[q]), int(other_reps[d])))
    return links


def _members(row: dict) -> tuple:
    return tuple(np.frombuffer(row[c].as_py(), t) for c, t in (("reps", np.int64), ("sizes", np.int64), ("tokens", np.uint64)))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}


def _bounded(percent: int):
    """Of each pair's queries those that the matrix row lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in _rows(batch):
                reps, sizes, tokens = _members(row)
                good = through_bound(percent, sizes, tokens, np.frombuffer(row["matrix"].as_py(), np.uint64), row["least"].as_py())
                if good.any():
                    for column, value in zip(out, (row["b"].as_py(), reps[good].tobytes(), sizes[good].tobytes(), tokens[np.repeat(good, sizes)].tobytes())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), *[pa.binary()] * 3))], names=["b", "q_reps", "q_sizes", "q_tokens"])

    return run


def _opened(percent: int, every: bool, across: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for row in _rows(batch):
                queries = _members({c: row[f"q_{c}"] for c in ("reps", "sizes", "tokens")}) if across else _members(row)
                links += open_groups(percent, queries, _members(row) if across else None, every)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def class_links(sets: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """(a, b): links between set representatives of ``sets`` (rep, n, h1, h2, tokens), enough for the components of all links, or ``every`` one."""
    spark = sets.sparkSession
    small_batches(spark)
    counted = sets.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") > COMMON_OVER)
    commonest = sorted((r[0] & 0xFFFFFFFFFFFFFFFF, r[1]) for r in counted.orderBy(F.desc("count"), "token").limit(COMMON_MOST).collect())
    common = spark.sparkContext.broadcast((np.array([t for t, _ in commonest], np.uint64), np.array([n for _, n in commonest], np.int64)))
    topped = sets.mapInArrow(_with_commonest(common), "rep long, n long, h1 long, h2 long, tokens array<long>, top long")
    order = ("top", "h1", "h2", "n", "rep")
    ordered = topped.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    groups = cut(ordered.select("rep", "h1", "top", "tokens").mapInArrow(_grouped(percent, common), GROUPS))
    keys = groups.select("gid", "least", "most", F.explode("keys").alias("key"))
    x, y = keys.alias("x"), keys.alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("x.gid") < F.col("y.gid")) & (100 * F.col("x.most") >= percent * F.col("y.least")) & (100 * F.col("y.most") >= percent * F.col("x.least"))
    pairs = x.join(y, meet).select(F.col("x.gid").alias("a"), F.col("y.gid").alias("b")).distinct()
    members = groups.select("gid", "reps", "sizes", "tokens")
    # queries of a against the matrix row of b; b's members only for queries that pass
    asked = pairs.join(members.withColumnRenamed("gid", "a"), "a").join(groups.select(F.col("gid").alias("b"), "matrix", "least"), "b")
    passed = asked.select("b", "reps", "sizes", "tokens", "matrix", "least").mapInArrow(_bounded(percent), "b long, q_reps binary, q_sizes binary, q_tokens binary")
    across = passed.join(members.withColumnRenamed("gid", "b"), "b").mapInArrow(_opened(percent, every, True), "a long, b long")
    within = members.where(F.octet_length("reps") > 8).mapInArrow(_opened(percent, every, False), "a long, b long")
    return across.union(within)


def _classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows with facts, classes of equal sets, those that may link, their sets)."""
    base = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    facts = cut(set_classes(base.select("rid", "text"), width))
    rows = cut(facts.join(base.select("rid", "doc_id"), "rid"))
    classes = rows.where("n > 0").groupBy(*CLASS).agg(F.min("rid").alias("rep"), F.max("alone").alias("alone"), F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    alive = cut(classes.where(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")))
    sets = cut(base.select("rid", "text").join(alive.select(F.col("rep").alias("rid")), "rid", "left_semi").mapInArrow(_token_sets(width), "rep long, n long, h1 long, h2 long, tokens array<long>"))
    return rows, classes, alive, sets


#: what tells the classes of equal sets apart
CLASS = ["n", "d1", "d2"]


def _brought_back(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of non-empty sets with the columns of their class (``named``, with its number of ``copies``).

    A class of over a thousandth of the rows would fill a task of the join: there are under a thousand such, so they are broadcast.
    """
    least, some = rows.count() / HOT_CLASSES, rows.where("n > 0")
    hot = F.broadcast(named.where(F.col("copies") > least))
    rare = some.join(hot.select(*CLASS), CLASS, "left_anti").join(named.where(F.col("copies") <= least), CLASS)
    return some.join(hot, CLASS).unionByName(rare)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: rid, doc_id, n_shingles, component_id (the smallest id reachable by links) and component_row.

    Texts link when 100 * intersection >= ``percent`` * union of their sets of distinct ``width``-word shingles
    (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``; a shorter text is one shingle). A null, empty or blank text has
    an empty set and is its own component. Rows of equal sets are one class however many they are. A null id
    counts only where a component has no other; an empty table gives no rows; other columns are not read.
    """
    rows, classes, alive, sets = _classes(docs, width, percent, id_col, text_col)
    roots = components(class_links(sets, percent))
    # smallest id of each component, brought back to its classes, then to the rows
    joined = alive.join(roots.select(F.col("v").alias("rep"), "root"), "rep")
    best = joined.groupBy("root").agg(F.min("class_id").alias("component_id"))
    linked = cut(joined.join(best, "root").select(*CLASS, "component_id", "root"))
    named = classes.join(linked, CLASS, "left").select(
        *CLASS, "copies", F.when(F.col("root").isNull(), F.col("class_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "rep").alias("component_row")
    )
    lone = rows.where("n = 0").withColumns({"component_id": F.col("doc_id"), "component_row": F.col("rid")})
    placed = _brought_back(rows, cut(named)).drop("copies").unionByName(lone)
    return placed.select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", "component_row")


def near_pairs(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join itself: (pairs of linked classes, members of the classes).

    Pairs: (class_a, class_b), each once; members: one row for each row (rid, doc_id, n_shingles, class, links), where links is
    the number of other rows it links with. A class is the rows of one set, known by its smallest rid; rows of a class link with
    one another, and with every row of a class that theirs is paired with. Awkward rows as in :func:`near_duplicates`.
    """
    rows, classes, _, sets = _classes(docs, width, percent, id_col, text_col)
    pairs = cut(class_links(sets, percent, every=True).select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b")).distinct())
    ends = pairs.select(F.col("class_a").alias("rep"), F.col("class_b").alias("other")).union(pairs.select("class_b", "class_a"))
    across = ends.join(classes.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("across"))
    named = cut(classes.select(*CLASS, "rep", "copies").join(across, "rep", "left").select(*CLASS, "copies", F.col("rep").alias("class"), (F.coalesce("across", F.lit(0)) + F.col("copies") - 1).alias("links")))
    lone = rows.where("n = 0").withColumns({"class": F.col("rid"), "links": F.lit(0).cast("long")})
    return pairs, _brought_back(rows, named).drop("copies").unionByName(lone).select("rid", "doc_id", F.col("n").alias("n_shingles"), "class", "links")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) with the smallest id of each component of :func:`near_duplicates`."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    kept = near_duplicates(docs, width, percent, id_col, text_col).groupBy("component_row").agg(F.min(order).alias("first"))
    return numbered(docs, "__rid").join(kept.select(F.col("first.rid").alias("__rid")), "__rid", "left_semi").drop("__rid")


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=90).drop("rid", "component_row")


OP5_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS k
  FROM d
), t AS (SELECT rid, len(k) AS n, unnest(k) AS k FROM s),
p AS (
  SELECT x.rid AS a, y.rid AS b FROM t x JOIN t y ON y.k = x.k AND y.rid <> x.rid
  GROUP BY x.rid, y.rid, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), r AS (SELECT rid AS a, rid AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b)
SELECT s.doc_id, CAST(len(s.k) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN r ON r.a = s.rid JOIN s o ON o.rid = r.b GROUP BY s.rid, s.doc_id, len(s.k)
"""
