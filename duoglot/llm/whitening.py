"""Whitening of embeddings with exact covariance arithmetic.

Entries become whole numbers, so the scatter matrix ``n·Σxxᵀ − SSᵀ`` (``n²`` times the covariance) is
known exactly. Its principal components follow without any rounding in between:

1. the tasks add up products of the entries (as limbs of 16 bits in matrix products that cannot
   round); one row per matrix entry comes to the driver;
2. the characteristic polynomial of the matrix is formed modulo many primes, by reduction to
   Hessenberg form: the primes are the rows of a Spark job; the coefficients follow by the Chinese
   remainder theorem, as many primes as their bound asks for;
3. all roots are real, so Descartes' rule of signs counts those above a number exactly: the largest
   roots are separated by bisection and refined by the sign of the polynomial, to ``ROOT_BITS`` bits;
4. each component is the null space of the matrix minus its root: inverse iteration in fixed-point
   numbers of ``SOLVE_BITS`` bits, rounded to doubles at the very end;
5. the tasks project the vectors; the covariance of the stored results is compared with the identity.

What the driver holds depends on the width of the vectors only.

Vectors that are null or hold null or non-finite entries take no part. Every other row does, repeated
ones as often as they occur, null ids too. Vectors of different width are compared as if the shorter
ones went on with zeros. Scaled entries beyond ±2**62 count as ±2**62. Components of variance 0
have no whitened value: there are no rows for them (none at all for fewer than two different
vectors). Equal eigenvalues: any orthonormal basis of their common space, the same for all rows.
Further columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duoglot.llm.common import stored

SCALE = 1024
LARGEST = 1 << 62
LIMB_BITS = 16
ROOT_BITS = 160
SOLVE_BITS = 256
PRIMES_PER_TASK = 16


def whole_entries(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """``(kept, entries)``: which rows take part, and ``floor(scale * c)`` of those, zeros behind
    shorter vectors."""
    lists = column.cast(pa.large_list(pa.float64()))
    n = len(lists)
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)     # null entries are NaN
    sizes = np.diff(offsets)
    present = np.asarray(lists.is_valid())
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    kept = present & (bad[offsets[1:]] == bad[offsets[:-1]]) if n else np.zeros(0, dtype=bool)
    width = int(sizes[kept].max()) if kept.any() else 0
    entries = np.zeros((int(kept.sum()), width), dtype=np.int64)
    cells = np.arange(width)[None, :] < sizes[kept][:, None]
    source = (offsets[:-1][kept][:, None] + np.arange(width)[None, :])[cells]
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(flat[source] * scale), -LARGEST, LARGEST)
    entries[cells] = scaled.astype(np.int64)
    return kept, entries


def _limbs(entries: np.ndarray) -> list[np.ndarray]:
    """Entries as digits of 16 bits, the last one signed; one suffices for entries below 2**15."""
    out, rest = [], entries
    while rest.size and np.abs(rest).max() >= 1 << (LIMB_BITS - 1):
        out.append((rest & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        rest = rest >> LIMB_BITS
    return [*out, rest.astype(np.float64)]


def _grown(matrix: np.ndarray, width: int) -> np.ndarray:
    more = width - matrix.shape[-1]
    return np.pad(matrix, [(0, more)] * matrix.ndim) if more > 0 else matrix


def scatter_parts(vectors: DataFrame) -> DataFrame:
    """``(i, j, shift, total)``: what all vectors add to ``Σ yᵢyⱼ`` (i ≤ j) in units of
    ``2**(16 * shift)``; ``i = -1`` holds the sums of the entries, ``i = j = -1`` the number of rows."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products: dict[int, np.ndarray] = {}
        sums: dict[int, np.ndarray] = {}
        n = width = 0
        for batch in batches:
            _, entries = whole_entries(batch.column("embedding"))
            if not len(entries):
                continue
            n, width = n + len(entries), max(width, entries.shape[1])
            limbs = _limbs(entries)
            for a, left in enumerate(limbs):
                own = left.sum(axis=0).astype(np.int64)
                sums[a] = _grown(sums.get(a, own[:0]), width) + _grown(own, width)
                for b, right in enumerate(limbs):
                    # Below 2**32 times the rows of a batch: whole numbers in a double.
                    part = (left.T @ right).astype(np.int64)
                    products[a + b] = _grown(products.get(a + b, part[:0, :0]), width) + _grown(part, width)
        rows = [(-1, -1, 0, n)] if n else []
        rows += [(-1, j, shift, int(v)) for shift, own in sums.items() for j, v in enumerate(own)]
        for shift, matrix in products.items():
            upper = np.triu_indices(matrix.shape[0])
            rows += zip(upper[0].tolist(), upper[1].tolist(), [shift] * len(upper[0]), matrix[upper].tolist())
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=["i", "j", "shift", "total"])

    return (vectors.select("embedding").mapInArrow(add_up, "i int, j int, shift int, total bigint")
            .groupBy("i", "j", "shift").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))


@dataclass
class Scatter:
    """Exact moments: rows, sums per dimension and ``n·Σxxᵀ − SSᵀ``."""

    n: int
    sums: list[int]
    matrix: list[list[int]]


def scatter(vectors: DataFrame) -> Scatter:
    rows = scatter_parts(vectors).collect()      # (width + 1)² / 2 rows and their limbs
    width = max((r["j"] for r in rows), default=-1) + 1
    n, sums = 0, [0] * width
    products = [[0] * width for _ in range(width)]
    for r in rows:
        value = int(r["total"]) << (LIMB_BITS * r["shift"])
        if r["j"] < 0:
            n = int(r["total"])
        elif r["i"] < 0:
            sums[r["j"]] += value
        else:
            products[r["i"]][r["j"]] += value
    matrix = [[n * products[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(width)]
              for i in range(width)]
    return Scatter(n, sums, matrix)


# --- characteristic polynomial -------------------------------------------------------

def _is_prime(n: int) -> bool:
    """Miller and Rabin; the bases 2, 3, 5 and 7 decide for all numbers below 3 billion."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes below 2**31, from the top, whose product has more than ``bits`` bits."""
    out, have, at = [], 0.0, (1 << 31) - 1
    while have <= bits:
        if _is_prime(at):
            out.append(at)
            have += math.log2(at)
        at -= 2
    return out


def hessenberg_polynomials(matrix: list[list[int]], primes: np.ndarray) -> np.ndarray:
    """Characteristic polynomials modulo each prime, constant term first."""
    d, many = len(matrix), len(primes)
    p = primes.astype(np.int64)
    h = np.array([[[v % q for v in row] for row in matrix] for q in primes.tolist()], dtype=np.int64)
    p1, p2 = p[:, None], p[:, None, None]
    for k in range(d - 2):
        for at in np.nonzero(h[:, k + 1, k] == 0)[0]:
            below = np.nonzero(h[at, k + 2:, k])[0]
            if len(below):                      # a similar matrix with another pivot
                r = k + 2 + below[0]
                h[at, [k + 1, r]] = h[at, [r, k + 1]]
                h[at][:, [k + 1, r]] = h[at][:, [r, k + 1]]
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(h[:, k + 1, k], p)], dtype=np.int64)
        factor = h[:, k + 2:, k] * inverse[:, None] % p1
        h[:, k + 2:, :] = (h[:, k + 2:, :] - factor[:, :, None] * h[:, k + 1:k + 2, :] % p2) % p2
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2:] * factor[:, None, :] % p2).sum(axis=2)) % p1
    polynomials = np.zeros((d + 1, many, d + 1), dtype=np.int64)
    polynomials[0, :, 0] = 1
    for k in range(1, d + 1):
        before = polynomials[k - 1]
        now = np.roll(before, 1, axis=1)
        now[:, 0] = 0
        now = now - h[:, k - 1, k - 1][:, None] * before % p1
        chain = np.ones(many, dtype=np.int64)
        for i in range(1, k):
            chain = chain * h[:, k - i, k - i - 1] % p
            now = now - (chain * h[:, k - i - 1, k - 1] % p)[:, None] * polynomials[k - i - 1] % p1
        polynomials[k] = now % p1
    return polynomials[d]


def coefficient_bits(matrix: list[list[int]]) -> int:
    """No coefficient of the polynomial has more bits (Maclaurin: the symmetric functions of
    non-negative roots are largest where all roots are equal)."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    largest = max(math.comb(d, k) * Fraction(trace, d) ** k for k in range(d + 1))
    return math.ceil(largest).bit_length() + 2


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of ``det(x − M)``, constant term first; the primes are dealt to tasks."""
    d = len(matrix)
    primes = primes_for(coefficient_bits(matrix))
    tasks = -(-len(primes) // PRIMES_PER_TASK)
    shared = spark.sparkContext.broadcast(matrix)      # width², whatever the number of rows

    def reduce_modulo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            if len(own):
                found = hessenberg_polynomials(shared.value, own)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(
                    found.tolist(), pa.list_(pa.int64()))], names=["prime", "residues"])

    rows = spark.createDataFrame([(q,) for q in primes], "prime bigint").repartition(tasks).mapInArrow(
        reduce_modulo, "prime bigint, residues array<bigint>").collect()
    whole = math.prod(r["prime"] for r in rows)
    out = [0] * (d + 1)
    for r in rows:
        rest = whole // r["prime"]
        unit = rest * pow(rest, -1, r["prime"])
        for k, residue in enumerate(r["residues"]):
            out[k] += residue * unit
    out = [c % whole for c in out]
    return [c - whole if c > whole // 2 else c for c in out]


# --- roots ---------------------------------------------------------------------------

def roots_above(polynomial: list[int], at: int) -> int:
    """How many roots (all real, counted with multiplicity) are larger than ``at``."""
    shifted = list(polynomial)
    for low in range(len(shifted) - 1):
        for k in range(len(shifted) - 2, low - 1, -1):
            shifted[k] += at * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value_sign(polynomial: list[int], at: int) -> int:
    total = 0
    for c in reversed(polynomial):
        total = total * at + c
    return (total > 0) - (total < 0)


def largest_roots(polynomial: list[int], count: int) -> tuple[list[int], int]:
    """``(roots, bits)``: the ``count`` largest positive roots, falling, equal ones repeated, in
    units of ``2**-bits`` and right to one unit."""
    d = len(polynomial) - 1
    trace = -polynomial[d - 1] if d else 0
    count = min(count, roots_above(polynomial, 0)) if d else 0
    if not count:
        return [], 0
    # Roots times 2**bits are the roots of this polynomial of whole coefficients. The smallest
    # wanted one may be far below 1 only if the matrix is tiny, so bits beyond the point suffice.
    bits = ROOT_BITS
    scaled = [c << (bits * (d - k)) for k, c in enumerate(polynomial)]
    top = (trace << bits) + 1
    # Half-open intervals (low, high] with the number of roots above either end.
    open_, closed = [(0, top, roots_above(scaled, 0), 0)], []
    while open_:
        low, high, above_low, above_high = open_.pop()
        if above_high >= count or above_low == above_high:
            continue
        if above_low - above_high == 1 or high - low == 1:
            closed.append((low, high, above_low - above_high))
            continue
        middle = (low + high) // 2
        above = roots_above(scaled, middle)
        open_ += [(low, middle, above_low, above), (middle, high, above, above_high)]
    roots = []
    for low, high, n in closed:
        if n == 1:
            sign = _value_sign(scaled, high)
            if sign == 0:
                low = high
            while high - low > 1:
                middle = (low + high) // 2
                here = _value_sign(scaled, middle)
                if here == 0:
                    high = middle
                    break
                low, high = (low, middle) if here == sign else (middle, high)
        roots += [high] * n
    return sorted(roots, reverse=True)[:count], bits


# --- components ----------------------------------------------------------------------

def _null_vectors(matrix: list[list[int]], root: int, bits: int, many: int) -> list[np.ndarray]:
    """``many`` orthonormal vectors that the matrix minus ``root / 2**bits`` sends to zero, as
    fixed-point numbers, by inverse iteration."""
    d, one = len(matrix), 1 << SOLVE_BITS
    # Entries are divided by a power of two near the largest one: all numbers are about one.
    down = max(1, max(abs(v) for row in matrix for v in row).bit_length())
    work = np.array([[(v << SOLVE_BITS) >> down for v in row] for row in matrix], dtype=object)
    shift = (root << SOLVE_BITS) >> (bits + down)
    for i in range(d):
        work[i, i] -= shift
    order = np.arange(d)
    factors = np.zeros((d, d), dtype=object)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda r: abs(work[k + r, k]))
        if pivot != k:
            for rows in (work, factors, order):
                rows[[k, pivot]] = rows[[pivot, k]]
        if work[k, k] == 0:
            work[k, k] = 1                       # one unit: the direction is what counts
        for r in range(k + 1, d):
            f = (work[r, k] << SOLVE_BITS) // work[k, k]
            factors[r, k] = f
            if f:
                work[r, k:] = work[r, k:] - np.array([f * v >> SOLVE_BITS for v in work[k, k:]], dtype=object)
                work[r, k] = 0

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for r in range(d):
            x[r] -= sum(int(factors[r, k]) * int(x[k]) for k in range(r)) >> SOLVE_BITS
        for r in range(d - 1, -1, -1):
            rest = x[r] - (sum(int(work[r, k]) * int(x[k]) for k in range(r + 1, d)) >> SOLVE_BITS)
            x[r] = (rest << SOLVE_BITS) // work[r, r]
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        length = math.isqrt(sum(int(v) * int(v) for v in x))
        return np.array([(int(v) << SOLVE_BITS) // max(length, 1) for v in x], dtype=object)

    found: list[np.ndarray] = []
    draw = np.random.default_rng(1)
    for _ in range(many):
        x = unit(np.array([int(v) << (SOLVE_BITS - 20) for v in draw.integers(1, 1 << 20, d)], dtype=object))
        for _ in range(3):
            for known in found:
                along = sum(int(a) * int(b) for a, b in zip(known, x)) >> SOLVE_BITS
                x = x - np.array([along * int(v) >> SOLVE_BITS for v in known], dtype=object)
            x = unit(solve(unit(x)))
        for known in found:
            along = sum(int(a) * int(b) for a, b in zip(known, x)) >> SOLVE_BITS
            x = x - np.array([along * int(v) >> SOLVE_BITS for v in known], dtype=object)
        found.append(unit(x))
    return found


@dataclass
class Components:
    """Largest eigenvalues of the covariance and their unit eigenvectors (rows)."""

    variances: list[float]
    vectors: np.ndarray
    explained: list[float]


def principal_components(spark, moments: Scatter, count: int) -> Components:
    d = len(moments.sums)
    trace = sum(moments.matrix[i][i] for i in range(d))
    if not trace:
        return Components([], np.zeros((0, d)), [])
    roots, bits = largest_roots(characteristic_polynomial(spark, moments.matrix), count)
    # Roots closer than this cannot be told apart by vectors of this precision: one space.
    apart = trace << (bits - ROOT_BITS // 2)
    vectors: list[np.ndarray] = []
    at = 0
    while at < len(roots):
        upto = at + 1
        while upto < len(roots) and roots[at] - roots[upto] <= apart:
            upto += 1
        vectors += _null_vectors(moments.matrix, roots[at], bits, upto - at)
        at = upto
    one = 1 << SOLVE_BITS
    rows = np.array([[float(Fraction(int(v), one)) for v in x] for x in vectors])
    for row in rows:
        row *= 1.0 if row[np.argmax(np.abs(row))] > 0 else -1.0
    unit = moments.n * moments.n << bits
    return Components([float(Fraction(r, unit)) for r in roots], rows,
                      [float(Fraction(r, trace << bits)) for r in roots])


def project(vectors: DataFrame, moments: Scatter, found: Components) -> DataFrame:
    """``(vec_id, deviation, whitened)`` of every row that takes part: the exact squared distance
    from the mean in units of ``1 / n²`` (decimal, null beyond 38 digits) and one value per component."""
    n, d = moments.n, len(moments.sums)
    sums = moments.sums
    mean = np.array([float(Fraction(s, n)) for s in sums]) if n else np.zeros(d)
    weights = (found.vectors / np.sqrt(np.array(found.variances))[:, None]).T
    largest_sum = max((abs(s) for s in sums), default=0)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, entries = whole_entries(batch.column("embedding"))
            entries = np.pad(entries, [(0, 0), (0, d - entries.shape[1])])
            whitened = (entries - mean) @ weights
            reach = n * int(np.abs(entries).max(initial=0)) + largest_sum
            if reach * reach * max(d, 1) < 1 << 63:
                off = entries * n - np.array(sums, dtype=np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:
                off = entries.astype(object) * n - np.array(sums, dtype=object)
                deviation = [int(v) for v in (off * off).sum(axis=1)]
            ids = batch.column("vec_id").filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([str(v) for v in deviation], pa.string()),
                 pa.array(whitened.tolist(), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(
        apply, f"vec_id {kind}, deviation string, whitened array<double>").withColumn(
        "deviation", F.expr("try_cast(deviation AS decimal(38,0))"))


def identity_error(whitened: DataFrame, count: int) -> float:
    """Largest absolute entry of the covariance of the whitened values minus the identity.

    The values are centred already but for rounding, so sums of their products lose nothing."""
    at = [F.col("whitened")[i] for i in range(count)]
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    row = whitened.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(at)],
                       *[F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    n = row["n"]
    return max(abs(row[f"p{i}_{j}"] / n - row[f"s{i}"] / n * row[f"s{j}"] / n - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, count: int = 8) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each row that
    takes part and each of the ``count`` components of largest variance, numbered from 1."""
    spark = vectors.sparkSession
    moments = scatter(vectors)
    found = principal_components(spark, moments, count) if moments.n else Components([], np.zeros((0, 0)), [])
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not found.variances:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), "
                                         "whitened double, explained double, identity_error double")
    whitened = stored(project(vectors, moments, found), "whitened")
    error = identity_error(whitened, len(found.variances))
    explained = F.array(*[F.lit(v) for v in found.explained])
    return whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(moments.n).cast("bigint").alias("n"),
        "deviation", "whitened", explained[F.col("_at")].alias("explained"),
        F.lit(error).alias("identity_error"))
