"""Near-duplicate records: grouped prefix join on term sets, verified on vectors and sets.

Terms are put into one global order, rare ones first: the DICTIONARY most frequent terms by falling rarity, all others
before them by a 128-bit hash. Two sets sharing at least the part `jaccard` of their union share a term among the first
|x| - ceil(jaccard * |x|) + 1 terms of each. Each record goes to the posting list of every term of that prefix. Within a
list, records of the same prefix and size are collapsed into one group; pairs of groups are filtered by size and by the
place of the shared term in both prefixes; members of the groups left are expanded and verified by cosine and by their
whole term sets. A pair is reported only by the list of its first common term, so nothing is compared twice in the output.

A set travels as bytes: its rare terms' hashes, then its dictionary terms' numbers. Two rare terms are taken for one if
their 128-bit hashes are equal; among 10^12 different terms the odds of any such pair are below 10^-14. Lists are named by
64 bits of the first term; lists that share a name are only compared together.

Exact copies (same vector, same terms) form a class, known by a 128-bit hash of both: only its representative, the
least id, is joined, and each other copy comes out in one pair with it, so that a class of a third of all records gives a
third as many rows, not its square. Nothing depends on how the rows lie in partitions.

A term of more than LIST_ROWS occurrences would have a list growing with the data. Pairs that must share two terms (all
but those of the smallest sets) share their first two among one prefix term and the terms after it, up to one beyond the
prefix; so such a term is replaced by its pairs with those later terms, whose lists are far shorter. Lists that still
exceed LIST_ROWS, by an exact count, are split: records are hashed into parts, and each pair of parts is a list of its
own, so that a list of a third of all records is compared block by block in many tasks. The table of the lists to split is
joined, and broadcast only while it is small.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from mosaiq.operators import blocks as V
from mosaiq.operators.components import connected_components
from mosaiq.operators.packed import segment
from mosaiq.runtime import cut_lineage

MIN_COSINE = 0.965
MIN_JACCARD = 0.5
DICTIONARY = 16_384  # terms whose order is broadcast; more would only order rarer terms better
LIST_ROWS = 40_000
ROWS = 512
PAIR_BITS = 14  # DICTIONARY codes
PAIR = 1 << 40  # added to the numbers of lists of two terms
MOST_BROADCAST = 200_000  # rows of the table of long lists, 24 bytes each
WIDTH = 2
HEAD = 4
POSTED_BYTES = 1 << 26  # given out at once
SALTS = 32


def prefix_length(size: int, jaccard: float) -> int:
    return size - int(np.ceil(jaccard * size - 1e-9)) + 1


def term_order(posts: DataFrame, packed: str = "tags") -> list[tuple[str, int]]:
    """The DICTIONARY most frequent terms of all rows with their counts, rarest first. Counted per batch, then added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = Counter(t for s in batch.column(0).to_pylist() if s for t in segment(s))
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["term", "n"])

    counted = posts.select(packed).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return [(r.term, r.n) for r in reversed(counted.orderBy(F.desc("n"), "term").limit(DICTIONARY).collect())]


def term_hash(term: str) -> int:
    """A fixed 128-bit hash of the whole term, made negative: before every number of the dictionary."""
    return xxhash.xxh3_128_intdigest(term.encode()) - (1 << 128)


def set_bytes(terms: set[int]) -> bytes:
    """A set of term numbers in order: the count of hashes (HEAD bytes), the hashes, the dictionary numbers (2 bytes each)."""
    rare = sorted(t for t in terms if t < 0)
    common = sorted(t for t in terms if t >= 0)
    return len(rare).to_bytes(HEAD, "little") + b"".join((t + (1 << 128)).to_bytes(16, "big") for t in rare) + np.array(common, "<u2").tobytes()


def set_terms(data: bytes) -> list[int]:
    """The numbers of set_bytes(), in order."""
    end = HEAD + 16 * int.from_bytes(data[:HEAD], "little")
    common = np.frombuffer(data, "<u2", offset=end).tolist() if len(data) > end else []
    return [int.from_bytes(data[k : k + 16], "big") - (1 << 128) for k in range(HEAD, end, 16)] + common


def folded_records(posts: DataFrame, order: list[tuple[str, int]], key: str, packed: str, vector: str, dim: int) -> DataFrame:
    """(id, vec, terms, class) of each record with terms and a vector; terms as set_bytes().

    All rows of a record are folded into one: its terms are those of any row, its vector the least of the comparable
    ones. class is the same for the same vector and terms.
    """
    shared = posts.sparkSession.sparkContext.broadcast({t: k for k, (t, _) in enumerate(order)})
    source = posts.select(F.col(key).cast("long").alias("id"), F.col(packed).alias("packed"), F.col(vector).alias("vec")).where(F.col("id").isNotNull())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        memo: dict[str, int] = {}
        for batch in batches:
            rows, unit = V.comparable(batch.column(2), dim)
            small = [x.tobytes() for x in V.pack(unit, WIDTH)] if len(rows) else []
            by_id: dict[int, tuple[set[int], list]] = {}
            ids = batch.column(0).to_pylist()
            for i, s in zip(ids, batch.column(1).to_pylist()):
                terms = by_id.setdefault(i, (set(), []))[0]
                for t in segment(s) if s else ():
                    code = codes.get(t)
                    if code is None:
                        code = memo.get(t)
                        if code is None:
                            if len(memo) > 200_000:
                                memo.clear()
                            code = memo[t] = term_hash(t)
                    terms.add(code)
            for r, v in zip(rows.tolist(), small):
                by_id[ids[r]][1].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(by_id), pa.int64()), pa.array([set_bytes(x) for x, _ in by_id.values()], pa.binary()), pa.array([min(v) if v else None for _, v in by_id.values()], pa.binary())],
                names=["id", "terms", "vec"],
            )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, sets, vec = None, [], None

        def close() -> None:
            if vec is not None:
                whole = sets[0] if len(sets) == 1 else set_bytes({t for s in sets for t in set_terms(s)})
                if len(whole) > HEAD:
                    out.append((now, vec, whole, xxhash.xxh3_128_digest(vec + whole)))

        def take() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["id", "vec", "terms", "class"])

        for batch in batches:
            for i, t, v in zip(*(c.to_pylist() for c in batch.columns)):
                if i != now:
                    close()
                    now, sets, vec = i, [], None
                if t not in sets:
                    sets.append(t)
                vec = v if vec is None else vec if v is None else min(v, vec)
                if len(sets) > 64:
                    sets = [set_bytes({t for s in sets for t in set_terms(s)})]
                if len(out) > 20_000:
                    yield take()
        close()
        yield take()

    rows = source.mapInArrow(read, "id long, terms binary, vec binary").repartition("id").sortWithinPartitions("id")
    return rows.mapInArrow(fold, "id long, vec binary, terms binary, class binary")


def classes_of(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, vec, terms) of one record a class, the one of least id, and (id, rep) of the records of larger classes.

    The keys alone are counted. Classes of several records are joined with salts, so that a class of a third of all
    records is spread over tasks where the join isn't a broadcast one.
    """
    keys = records.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    several = cut_lineage(keys.where(F.col("n") > 1).select("class", "rep"))
    if not several.limit(1).count():
        return records.select("id", "vec", "terms"), several.select(F.col("rep").alias("id"), "rep")
    salted = several.select("class", "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    small = several.count() <= MOST_BROADCAST // SALTS
    if small:
        salted = F.broadcast(salted)
    known = records.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["class", "salt"], "left").select("id", "rep", "vec", "terms")
    if not small:
        known = cut_lineage(known)
    return known.where(F.col("rep").isNull() | (F.col("rep") == F.col("id"))).select("id", "vec", "terms"), known.where(F.col("rep").isNotNull()).select("id", "rep")


def lists_of(whole: list[int], frequent: int, jaccard: float) -> list[tuple[int, int]]:
    """(list, place) of each list that a record of these terms, in order, belongs to.

    Terms from the code `frequent` on have lists of pairs: PAIR + first term << 14 + second term; a rare term has the list
    named by 63 bits of its hash. place is such that size - place terms at most are shared with a record whose first
    common terms are those of the list.
    """
    out, size = [], len(whole)
    length = prefix_length(size, jaccard)
    for place, token in enumerate(whole[:length]):
        if token >= frequent:
            out += [(PAIR + (token << PAIR_BITS) + second, place + k) for k, second in enumerate(whole[place + 1 : length + 1])]
        if token < frequent or size <= (1 + jaccard) / jaccard - 1 + 1e-9:  # may share one term only
            out.append((token if token >= 0 else (token >> 65), place))
    return out


def _terms_of(list_number: int, whole: list[int]) -> bool:
    """Whether the first of these common terms are those of the list."""
    if list_number >= PAIR:
        return len(whole) > 1 and PAIR + (whole[0] << PAIR_BITS) + whole[1] == list_number
    return (whole[0] if whole[0] >= 0 else whole[0] >> 65) == list_number


def posting_rows(records: DataFrame, order: list[tuple[str, int]], jaccard: float) -> DataFrame:
    """(list, part, side, id, place, vec, terms): one row for each list (and pair of parts) that a record belongs to.

    part is 0 in a whole list, else the pair of parts; side tells the parts of a pair of different ones apart.
    """
    frequent = next((k for k, (_, n) in enumerate(order) if n > LIST_ROWS), len(order))
    every = frequent == 0  # terms beyond the dictionary may be as frequent; else no list of a rarer term can be long

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for whole in batch.column(0).to_pylist():
                seen.update(number for number, _ in lists_of(set_terms(whole), frequent, jaccard) if every or number >= frequent)
            if len(seen) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()))], names=["list", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["list", "n"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists, places, held = [], [], [], 0

            def take() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), batch.column(0).take(at), pa.array(places, pa.int32()), batch.column(1).take(at), batch.column(2).take(at)], names=["list", "id", "place", "vec", "terms"])

            for r, terms in enumerate(batch.column(2).to_pylist()):
                for number, place in lists_of(set_terms(terms), frequent, jaccard):
                    rows.append(r)
                    lists.append(number)
                    places.append(place)
                    held += len(terms) + 256
                    if held > POSTED_BYTES:
                        yield take()
                        rows, lists, places, held = [], [], [], 0
            yield take()

    posted = records.select("id", "vec", "terms").mapInArrow(post, "list long, id long, place int, vec binary, terms binary")
    whole = [F.lit(0).cast("long").alias("part"), F.lit(False).alias("side"), "id", "place", "vec", "terms"]
    if frequent >= len(order):
        return posted.select("list", *whole)  # no term is that frequent
    long = cut_lineage(records.select("terms").mapInArrow(count, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).where(F.col("n") > LIST_ROWS))
    if not (size := long.count()):
        return posted.select("list", *whole)
    times = long.select("list", F.ceil(F.col("n") / LIST_ROWS).cast("int").alias("times"))
    split = posted.join(F.broadcast(times) if size <= MOST_BROADCAST else times, "list", "left")
    own, other = F.pmod(F.xxhash64("id"), F.col("times")), F.col("other")
    pairs = F.explode(F.when(F.col("times") > 1, F.sequence(F.lit(0), F.col("times") - 1)).otherwise(F.array(F.lit(0))))
    spread = split.select("list", "times", "id", "place", "vec", "terms", pairs.alias("other")).withColumn("own", F.coalesce(own, F.lit(0)))
    part = F.shiftleft(F.least("own", "other").cast("long"), 32) + F.greatest("own", "other")
    return spread.select("list", part.alias("part"), (F.col("own") > other).alias("side"), "id", "place", "vec", "terms")


def join_list(number: int, ids: np.ndarray, place: np.ndarray, unit: np.ndarray, terms: list[list[int]], side: np.ndarray | None, cosine: float, jaccard: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b, of one posting list: pairs reaching both thresholds whose first common terms are those of the list.

    If side is given, only records of different sides are compared.
    """
    size = np.array([len(t) for t in terms], np.int32)
    prefixes: dict[tuple, int] = {}
    prefix = np.array([prefixes.setdefault((len(t), *t[: prefix_length(len(t), jaccard)]), len(prefixes)) for t in terms])
    order = np.lexsort((prefix, place, size))  # groups of equal prefix and size stand together
    place, unit, size, prefix = place[order], unit[order], size[order], prefix[order]
    half = None if side is None else side[order]
    start = np.nonzero(np.append(True, (prefix[1:] != prefix[:-1])))[0]
    stop = np.append(start[1:], len(ids))
    g_size, g_place = size[start].astype(np.float32), place[start].astype(np.float32)
    left = g_size - g_place  # terms from the shared one on
    found: list[tuple[np.ndarray, np.ndarray]] = []
    share = jaccard / (1 + jaccard)
    g = 0
    while g < len(start):
        h = max(int(np.searchsorted(start, start[g] + V.tile_rows(len(ids), ROWS))), g + 1)
        end = max(int(np.searchsorted(g_size, g_size[h - 1] / jaccard + 1e-4, side="right")), h)  # larger sets share too little
        fits = np.minimum(left[g:h, None], left[None, g:end]) >= share * (g_size[g:h, None] + g_size[None, g:end]) - 1e-4
        cols = np.nonzero(fits.any(0))[0]
        if len(cols):
            few = len(cols) == end - g
            member = np.arange(start[g], stop[end - 1]) if few else np.concatenate([np.arange(start[g + c], stop[g + c]) for c in cols])
            which = np.repeat(cols, stop[g + cols] - start[g + cols])
            row_group = np.repeat(np.arange(h - g), stop[g:h] - start[g:h])
            tile = V.tile_rows(len(member), ROWS)
            for s in range(start[g], stop[h - 1], tile):
                e = min(s + tile, stop[h - 1])
                close = unit[s:e] @ unit[member].T >= cosine
                if half is not None:
                    close &= half[s:e, None] != half[member][None, :]
                r, c = V.places(close)
                if len(r):
                    good = fits[row_group[r + s - start[g]], which[c]] & (s + r != member[c])
                    found.append((s + r[good], member[c[good]]))
        g = h
    if not found:
        return ids[:0], ids[:0]
    r, c = (np.concatenate(x) for x in zip(*found))
    pairs = np.unique(np.minimum(order[r], order[c]).astype(np.int64) * len(order) + np.maximum(order[r], order[c]))
    sets, keep = {}, []
    for code in pairs.tolist():
        x, y = divmod(code, len(order))
        a, b = (sets.get(k) or sets.setdefault(k, frozenset(terms[k])) for k in (x, y))
        common = a & b
        if common and len(common) >= jaccard * (len(a) + len(b) - len(common)) - 1e-9 and _terms_of(number, sorted(common)[:2]):
            keep.append(code)
    keep = np.array(keep, np.int64)
    a, b = ids[keep // len(order)], ids[keep % len(order)]
    apart = a != b  # a record stands twice where two of its lists share a name
    return np.minimum(a, b)[apart], np.maximum(a, b)[apart]


def _joined_lists(records: DataFrame, order: list[tuple[str, int]], min_cosine: float, min_jaccard: float, dim: int) -> DataFrame:
    """(point_a, point_b) of the pairs of all posting lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in V.by_key(batches):
            parts = rows.column("part").to_numpy()
            cuts = [0, *(np.nonzero(parts[1:] != parts[:-1])[0] + 1).tolist(), len(parts)]
            for s, e in zip(cuts, cuts[1:]):
                if e - s > 1:
                    a, b = joined(int(number), int(parts[s]), rows.slice(s, e - s))
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["point_a", "point_b"])

    def joined(number: int, part: int, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side = rows.column("side").to_numpy(zero_copy_only=False) if part >> 32 != part & 0xFFFFFFFF else None
        terms = [set_terms(x) for x in rows.column("terms").to_pylist()]
        return join_list(number, rows.column("id").to_numpy(), rows.column("place").to_numpy(), V.unpack(rows.column("vec"), dim), terms, side, min_cosine, min_jaccard)

    lists = posting_rows(records, order, min_jaccard)
    found = lists.repartition("list", "part").sortWithinPartitions("list", "part").mapInArrow(run, "point_a long, point_b long")
    return found.distinct()  # two lists of one name may both hold a pair


def near_duplicates(posts: DataFrame, key: str = "point_id", packed: str = "tags", vector: str = "image_vec", min_cosine: float = MIN_COSINE, min_jaccard: float = MIN_JACCARD, dim: int = V.DIM) -> DataFrame:
    """(point_a, point_b), point_a < point_b: pairs whose vectors and term sets are both that similar.

    Of exact copies only the one of least id is paired with other records, and each other copy with that one. Points
    without terms, without a comparable vector or with a null id belong to no pair; repeated rows count once.
    """
    order = term_order(posts, packed)
    heads, members = classes_of(cut_lineage(folded_records(posts, order, key, packed, vector, dim)))
    copies = members.where(F.col("id") != F.col("rep")).select(F.col("rep").alias("point_a"), F.col("id").alias("point_b"))
    return _joined_lists(heads, order, min_cosine, min_jaccard, dim).unionAll(copies)


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """(point_id, group_id, n_links): one row per point of the pairs; group_id is the least point of its group.

    n_links counts the pairs as they are given; near_duplicates() gives one pair a copy, linked_groups() counts all.
    """
    ends = pairs.select(F.col("point_a").alias("vertex")).unionAll(pairs.select(F.col("point_b").alias("vertex")))
    links = ends.groupBy("vertex").agg(F.count(F.lit(1)).alias("n_links"))
    found = connected_components(pairs, "point_a", "point_b")
    return found.join(links, "vertex").select(F.col("vertex").alias("point_id"), F.col("component").alias("group_id"), "n_links")


def linked_groups(posts: DataFrame, key: str = "point_id", packed: str = "tags", vector: str = "image_vec", min_cosine: float = MIN_COSINE, min_jaccard: float = MIN_JACCARD, dim: int = V.DIM) -> DataFrame:
    """(point_id, group_id, n_links): one row per point with a near-duplicate, and the number of all its near-duplicates.

    Only one record of each class of exact copies is joined. A member's links are the others of its class and all
    members of the classes linked to it.
    """
    order = term_order(posts, packed)
    heads, members = classes_of(cut_lineage(folded_records(posts, order, key, packed, vector, dim)))
    pairs = cut_lineage(_joined_lists(heads, order, min_cosine, min_jaccard, dim))
    large = cut_lineage(members.groupBy("rep").agg(F.count(F.lit(1)).alias("size")))
    ends = pairs.toDF("rep", "other").unionAll(pairs.select("point_b", "point_a"))
    weighed = ends.join(large.toDF("other", "size"), "other", "left")
    linked = weighed.groupBy("rep").agg(F.sum(F.coalesce("size", F.lit(1))).alias("linked"))
    component = connected_components(pairs, "point_a", "point_b").toDF("rep", "component")
    found = linked.join(component, "rep").join(large, "rep", "full").select("rep", F.coalesce("component", "rep").alias("group_id"), (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    found = cut_lineage(found)
    copies = members.where(F.col("id") != F.col("rep")).join(found, "rep").select(F.col("id").alias("point_id"), "group_id", "n_links")
    return found.select(F.col("rep").alias("point_id"), "group_id", "n_links").unionAll(copies)
