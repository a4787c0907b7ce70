"""Vector codes by product quantisation in exact integers (operator 12).

Vectors of integers are cut into ``PARTS`` equal parts, each coded by the index of its nearest codebook entry. Parts and entries
are zero-padded to a power of two M and put through the integer Walsh-Hadamard transform, rows in sequency order. M times the
squared distance is the sum of the squared differences of coefficients, so it is accumulated coefficient by coefficient, smooth
ones first, and an entry is dropped as soon as its sum exceeds the whole distance of the entry that leads after the first one.
Entries that tie are never dropped before the last coefficient, where the lowest index wins. There is no floating point.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.llm.exchange import record_batch
from feedforge.llm.vectors import as_long, floored, matrix_of, whole_vectors
from feedforge.session import written

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Bits of a digit of a sum; a sum that fits is one digit.
DIGIT = 40
#: Cells (rows times entries) that are compared at once.
CELLS = 1 << 20


def sequency_rows(size: int) -> np.ndarray:
    """The Hadamard matrix of a power of two, rows by their number of sign changes."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < size:
        rows = np.block([[rows, rows], [rows, -rows]])
    return rows[np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1), kind="stable")]


def _parts(x: np.ndarray) -> np.ndarray:
    """Rows of integers as (part, row, position)."""
    width = -(-x.shape[1] // PARTS)
    full = np.zeros((len(x), PARTS * width), x.dtype)
    full[:, : x.shape[1]] = x
    return full.reshape(len(x), PARTS, width).transpose(1, 0, 2)


def _transformed(part: np.ndarray) -> np.ndarray:
    """Coefficients of zero-padded rows in sequency order, one coefficient a row."""
    size = 1 << max(0, part.shape[1] - 1).bit_length()
    return sequency_rows(size)[:, : part.shape[1]].astype(part.dtype) @ part.T


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, lowest of several, and the squared distance."""
    if part.dtype != entries.dtype or max(_size(part), _size(entries)) * part.shape[1] >= 1 << 26:
        part, entries = part.astype(object), entries.astype(object)
    index, distance = np.zeros(len(part), np.int64), np.zeros(len(part), part.dtype)
    if not len(part):
        return index, distance
    ours, theirs = _transformed(part), _transformed(entries)
    step = max(1, CELLS // len(entries))
    for at in range(0, len(part), step):
        own = ours[:, at : at + step]
        rows = np.arange(own.shape[1])
        so_far = (own[0][:, None] - theirs[0][None, :]) ** 2
        bound = ((own - theirs[:, so_far.argmin(axis=1)]) ** 2).sum(axis=0)
        row, entry = np.nonzero(so_far <= bound[:, None])
        so_far = so_far[row, entry]
        for c in range(1, len(ours)):
            so_far = so_far + (own[c][row] - theirs[c][entry]) ** 2
            alive = so_far <= bound[row]
            row, entry, so_far = row[alive], entry[alive], so_far[alive]
        starts = np.searchsorted(row, rows)
        least = np.minimum.reduceat(so_far, starts)
        first = np.flatnonzero(so_far == least[row])
        first = first[np.unique(row[first], return_index=True)[1]]
        index[at : at + step], distance[at : at + step] = entry[first], least // len(ours)
    return index, distance


def _size(x: np.ndarray) -> int:
    return int(np.abs(x).max(initial=0))


def _keyed(table: DataFrame, key: str, vector: str, group: str | None) -> DataFrame:
    label = F.lit(None).cast("int") if group is None else F.col(group)
    rows = table.select(F.col(vector).alias("its_vector"), F.col(key).cast("long").alias("its_key"), label.alias("its_label"))
    return whole_vectors(rows, "its_vector")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return floored(matrix_of(batch.column(0)), SCALE)


def first_entries(rows: DataFrame, entries: int) -> list[np.ndarray]:
    """Codebooks from the rows of the smallest keys (then vectors), which alone reach the driver."""
    order = [F.asc_nulls_last("its_key"), F.asc("its_vector")]
    first = rows.select("its_vector", "its_key").orderBy(*order).limit(entries).collect()
    if not first:
        return []
    return list(_parts(floored(np.array([r.its_vector for r in first], np.float64), SCALE)))


def refined(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by the floored mean of the parts that are nearest to it; unused entries stay.

    Tasks add up (part, entry): count and sums, and Spark adds those; the driver gets one row per part and entry.
    """
    width = books[0].shape[1]
    names = ("part", "entry", "position", "digit", "n", "total")
    schema = pa.schema([(name, pa.int64()) for name in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, len(books[0])), np.int64)
        sums = np.zeros((PARTS, len(books[0]), width), object)
        for batch in batches:
            for p, part in enumerate(_parts(_rows(batch)) if batch.num_rows else ()):
                index, _ = nearest(part, books[p])
                counts[p] += np.bincount(index, minlength=len(books[p]))
                own = np.zeros((len(books[p]), width), part.dtype)
                np.add.at(own, index, part)
                sums[p] += own
        rows = []
        for p, e in zip(*np.nonzero(counts), strict=True):
            for at, total in enumerate(sums[p, e]):
                rows += [(p, e, at, k, counts[p, e] * (k == 0), digit) for k, digit in enumerate(_digits(total))]
        yield record_batch(schema, zip(*rows, strict=True) if rows else [[]] * len(names))

    sums = rows.select("its_vector").mapInArrow(run, ", ".join(f"{name} long" for name in names))
    totals = {}
    for r in sums.groupBy("part", "entry", "position", "digit").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        n, total = totals.get((r.part, r.entry, r.position), (0, 0))
        totals[r.part, r.entry, r.position] = n + r.n, total + (r.total << (DIGIT * r.digit))
    out = [book.astype(object) for book in books]
    for (p, e, at), (n, total) in totals.items():
        out[p][e, at] = total // n
    return [book.astype(np.int64) if _size(book) < 1 << 62 else book for book in out]


def _digits(total: int) -> list[int]:
    """An integer in digits of ``DIGIT`` bits, lowest first, each with its sign, so that Spark can sum them as longs."""
    sign, rest, digits = (-1 if total < 0 else 1), abs(int(total)), []
    while rest or not digits:
        digits.append(sign * (rest & ((1 << DIGIT) - 1)))
        rest >>= DIGIT
    return digits


def codebooks(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part after ``rounds`` refinements; none for an empty table."""
    books = first_entries(rows, entries)
    for _ in range(rounds if books else 0):
        books = refined(rows, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for v in book.ravel()).encode()).hexdigest()


def vector_codes(
    table: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    group: str | None = "label",
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Per remaining row of ``table``: ``key``, code (two hex digits a part), error, label_error and codebooks_sha256.

    Entries become floor(256 c). Rows whose vector is null or holds null or non-finite entries, and rows of another length than
    most, are left out. A length that 16 does not divide is zero-padded at its end, zeros of the entries included in the digest.
    Codebooks start from the rows of the smallest keys; of several rows of one key the smaller vector comes first, and rows without
    a key come last. With fewer rows than entries the codebooks are that much shorter. error is the sum of the squared distances,
    label_error its sum over the rows of the same ``group`` value (nulls are one group, and so are all rows without ``group``); either
    is null beyond a long. Other columns are ignored; an empty table gives no rows. Tasks hold codebooks and a batch of rows; the
    driver holds codebooks only. Sums per label are added up before the shuffle, so a frequent label gathers nowhere.
    """
    rows = _keyed(table, key, vector, group)
    books = codebooks(rows, entries, rounds)
    name = digest(books)
    schema = pa.schema([("its_key", pa.int64()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [nearest(part, book) for part, book in zip(_parts(_rows(batch)), books, strict=True)]
            codes = np.stack([i for i, _ in found], axis=1)
            total = sum(d for _, d in found)
            hexes = [bytes(row).hex() for row in codes.astype(np.uint8)]
            coded = record_batch(schema, [batch.column(1), hexes, as_long(total)])
            yield pa.RecordBatch.from_arrays([*coded.columns, batch.column(2)], names=[*schema.names, "its_label"])

    kind = dict(rows.dtypes)["its_label"]
    coded = written(rows.mapInArrow(run, f"its_key long, code string, error long, its_label {kind}"), "codes")
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = coded.groupBy("its_label").agg(whole.alias("total"))
    sums = sums.select(F.col("its_label").alias("summed"), F.expr("try_cast(total as bigint)").alias("label_error"))
    joined = coded.join(sums, F.col("its_label").eqNullSafe(F.col("summed")))
    return joined.select(F.col("its_key").alias(key), "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def _sql() -> str:
    """The query for vectors of 64 entries, two rounds written out."""
    cells = range(64 // PARTS)
    between = " + ".join(f"(a.v{i} - b.v{i}) * (a.v{i} - b.v{i})" for i in cells)
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)""",
        f"""parts AS (SELECT vec_id, label, p, {", ".join(f"x[p * {len(cells)} + {i + 1}] AS v{i}" for i in cells)}
            FROM kept, range({PARTS}) AS t(p))""",
        f"""first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES})""",
        f"""book0 AS (SELECT p, e, {", ".join(f"v{i}" for i in cells)} FROM parts JOIN first USING (vec_id))""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""near{r} AS (SELECT a.vec_id, a.p, min(struct_pack(d := {between}, e := b.e)) AS best
            FROM parts a JOIN book{r} b ON a.p = b.p GROUP BY a.vec_id, a.p)"""
        )
        if r < ROUNDS:
            means = ", ".join(f"CAST(floor(sum(v{i}) / count(*)) AS BIGINT) AS v{i}" for i in cells)
            steps.append(
                f"""mean{r} AS (SELECT p, best.e AS e, {means} FROM parts JOIN near{r} USING (vec_id, p) GROUP BY p, best.e),
            book{r + 1} AS (SELECT b.p, b.e, {", ".join(f"coalesce(m.v{i}, b.v{i}) AS v{i}" for i in cells)}
            FROM book{r} b LEFT JOIN mean{r} m ON b.p = m.p AND b.e = m.e)"""
            )
    entry = " || ',' || ".join(f"v{i}" for i in cells)
    return f"""WITH {", ".join(steps)},
        coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
            FROM near{ROUNDS} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg({entry}, ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


ORACLE_SQL = _sql()
