"""Scalar, string, collection and struct functions with the engine's rules for missing values, NaN and indexing. All are Columns, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticeframe.semantics import INF, NAN, col, divide, floordiv, floormod, if_else, log, number_range

__all__ = ["divide", "floordiv", "floormod", "if_else", "log", "number_range"]

# missing values and control


def is_defined(x) -> Column:
    return col(x).isNotNull()


def is_missing(x) -> Column:
    return col(x).isNull()


def is_nan(x) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.isnan(x))


def is_infinite(x) -> Column:
    return F.abs(col(x)) == INF


def is_finite(x) -> Column:
    x = col(x).cast("double")
    return F.when(x.isNotNull(), ~F.isnan(x) & (F.abs(x) != INF))


def or_else(a, b) -> Column:
    return F.coalesce(col(a), col(b))


coalesce = lambda *xs: F.coalesce(*map(col, xs))


def or_missing(condition, x) -> Column:
    return F.when(col(condition), col(x))


class Case:
    """when(condition, value)... then default(value), or_missing() or or_error(message). A missing condition gives a missing result unless missing_false is set."""

    def __init__(self, missing_false: bool = False, cases=()):
        self.missing_false, self.cases = missing_false, tuple(cases)

    def when(self, condition, then) -> Case:
        return Case(self.missing_false, (*self.cases, (col(condition), then if isinstance(then, Column) else F.lit(then))))

    def default(self, then) -> Column:
        out = then if isinstance(then, Column) else F.lit(then)
        for condition, value in reversed(self.cases):
            out = F.when(condition, value).otherwise(out) if self.missing_false else F.when(condition.isNull(), None).when(condition, value).otherwise(out)
        return out

    def or_missing(self) -> Column:
        return self.default(F.lit(None))

    def or_error(self, message: str) -> Column:
        return self.default(F.raise_error(F.lit(message)))


class Switch:
    """when(value, then)... on one expression, as Case; when_missing(then) for a missing expression."""

    def __init__(self, x, cases=(), missing=None):
        self.x, self.cases, self.missing = col(x), tuple(cases), missing

    def when(self, value, then) -> Switch:
        return Switch(self.x, (*self.cases, (value, then)), self.missing)

    def when_missing(self, then) -> Switch:
        return Switch(self.x, self.cases, then)

    def default(self, then) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        out = F.when(self.x.isNull(), lit(self.missing))
        for value, result in self.cases:
            out = out.when(self.x == lit(value), lit(result))
        return out.otherwise(lit(then))

    def or_missing(self) -> Column:
        return self.default(F.lit(None))

    def or_error(self, message: str) -> Column:
        return self.default(F.raise_error(F.lit(message)))


def bind(f: Callable, *xs) -> Column:
    """f applied to expressions; Catalyst shares common subexpressions."""
    return f(*map(col, xs))


# numbers


def exp(x) -> Column:
    return F.exp(col(x))


def log10(x) -> Column:
    return log(col(x), 10)


def sqrt(x) -> Column:
    x = col(x).cast("double")
    return F.when(x < 0, F.lit(NAN)).otherwise(F.sqrt(F.when(x >= 0, x)))


def floor(x) -> Column:
    return F.floor(col(x)).cast("double")


def ceil(x) -> Column:
    return F.ceil(col(x)).cast("double")


def abs(x) -> Column:  # noqa: A001
    return F.abs(col(x))


def sign(x) -> Column:
    return F.signum(col(x))


def logit(x) -> Column:
    x = col(x).cast("double")
    return log(divide(x, 1 - x))


def expit(x) -> Column:
    return 1 / (1 + F.exp(-col(x).cast("double")))


def approx_equal(x, y, tolerance: float = 1e-6, absolute: bool = False, nan_same: bool = False) -> Column:
    x, y = col(x).cast("double"), col(y).cast("double")
    bound = F.lit(tolerance) if absolute else tolerance * F.greatest(F.abs(x), F.abs(y))
    near = (x == y) | (F.abs(x - y) <= bound)
    return F.when(F.isnan(x) | F.isnan(y), F.isnan(x) & F.isnan(y) if nan_same else F.lit(False)).otherwise(near)


def triangle(n) -> Column:
    n = col(n)
    return floordiv(n * (n + 1), F.lit(2))


def entropy(s) -> Column:
    """Shannon entropy in bits of a string's characters."""
    chars = F.filter(F.split(col(s), ""), lambda c: c != "")
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def bit_and(x, y) -> Column:
    return col(x).bitwiseAND(col(y))


def bit_or(x, y) -> Column:
    return col(x).bitwiseOR(col(y))


def bit_xor(x, y) -> Column:
    return col(x).bitwiseXOR(col(y))


def bit_not(x) -> Column:
    return F.bitwise_not(col(x))


def bit_count(x) -> Column:
    return F.bit_count(col(x))


def bit_lshift(x, n: int, width: int = 32) -> Column:
    """0 for shifts of the width or more."""
    return F.shiftleft(col(x), n) if n < width else F.when(col(x).isNotNull(), F.lit(0))


def bit_rshift(x, n: int, logical: bool = False, width: int = 32) -> Column:
    if n >= width:
        return F.when(col(x).isNotNull(), F.lit(0)) if logical else F.when(col(x) < 0, F.lit(-1)).when(col(x) >= 0, F.lit(0))
    return F.shiftrightunsigned(col(x), n) if logical else F.shiftright(col(x), n)


# parsing and conversion


def parse_int32(s) -> Column:
    return F.trim(col(s)).try_cast("int")


def parse_int64(s) -> Column:
    return F.trim(col(s)).try_cast("bigint")


def parse_float64(s) -> Column:
    return F.trim(col(s)).try_cast("double")


def parse_float32(s) -> Column:
    return F.trim(col(s)).try_cast("float")


def parse_bool(s) -> Column:
    return F.when(F.lower(col(s)).isin("true", "false"), F.lower(col(s)) == "true")


def json(x) -> Column:
    return F.to_json(col(x))


def parse_json(s, schema: str) -> Column:
    return F.from_json(col(s), schema)


def strftime(format: str, seconds, zone: str = "UTC") -> Column:  # noqa: A002
    """A time in seconds since the epoch as text, in Java's pattern letters."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(col(seconds)), zone), format)


def strptime(time, format: str, zone: str = "UTC") -> Column:  # noqa: A002
    return F.unix_timestamp(F.to_utc_timestamp(F.to_timestamp(col(time), format), zone))


# strings (0-based, as Python's)


def length(s) -> Column:
    return F.length(col(s))


def char_at(s, i) -> Column:
    """The character at i; negative i count from the end."""
    s, i = col(s), col(i)
    return F.when((i >= -F.length(s)) & (i < F.length(s)), s.substr(F.when(i < 0, F.length(s) + i).otherwise(i) + 1, F.lit(1)))


def slice_string(s, start=None, stop=None) -> Column:
    s = col(s)
    n = F.length(s)
    clamp = lambda v, default: default if v is None else F.greatest(F.lit(0), F.least(n, F.when(F.lit(v) < 0, n + v).otherwise(F.lit(v))))
    low, high = clamp(start, F.lit(0)), clamp(stop, n)
    return s.substr(low + 1, F.greatest(high - low, F.lit(0)))


def replace(s, pattern: str, by: str) -> Column:
    return F.regexp_replace(col(s), pattern, by)


def split(s, pattern: str, n: int = -1) -> Column:
    return F.split(col(s), pattern, n)


def contains(s, part) -> Column:
    return F.contains(col(s), part if isinstance(part, Column) else F.lit(part))


def startswith(s, part) -> Column:
    return col(s).startswith(part)


def endswith(s, part) -> Column:
    return col(s).endswith(part)


def matches(s, pattern: str, full: bool = False) -> Column:
    return F.rlike(col(s), F.lit(f"^(?:{pattern})$" if full else pattern))


def first_match_in(s, pattern: str, groups: int) -> Column:
    """The groups of the first match as an array, missing without one."""
    s = col(s)
    return F.when(F.rlike(s, F.lit(pattern)), F.array(*[F.regexp_extract(s, pattern, i + 1) for i in range(groups)]))


def find(s, part: str) -> Column:
    """The first place of a substring, -1 without one."""
    return F.instr(col(s), part) - 1


def delimit(x, delimiter: str = ",") -> Column:
    return F.array_join(col(x), delimiter, "null")


def translate(s, mapping: dict[str, str]) -> Column:
    out = F.filter(F.split(col(s), ""), lambda c: c != "")
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.array_join(F.transform(out, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def hamming(a, b) -> Column:
    """In how many places two strings of equal length differ; an error for others."""
    a, b = col(a), col(b)
    x, y = F.split(a, ""), F.split(b, "")
    same = F.length(a) == F.length(b)
    return F.when(same, F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda d: d))).otherwise(F.raise_error(F.lit("strings differ in length")))


def format(template: str, *xs) -> Column:  # noqa: A001
    return F.format_string(template, *map(col, xs))


def edit_distance(a, b) -> Column:
    return F.levenshtein(col(a), col(b))


# arrays


def element(x, i) -> Column:
    """0-based; negative i count from the end; out of range is an error."""
    x, i = col(x), col(i)
    return F.element_at(x, F.when(i >= 0, i + 1).otherwise(i))


def get(x, i) -> Column:
    return F.get(col(x), col(i))


def slice(x, start: int, stop: int) -> Column:  # noqa: A001
    return F.slice(col(x), start + 1, max_of_ints(stop - start, 0))


def max_of_ints(a: int, b: int) -> int:
    return a if a > b else b


def has(x, item) -> Column:
    """Missing items equal missing ones."""
    item = item if isinstance(item, Column) else F.lit(item)
    return F.coalesce(F.exists(col(x), lambda e: e.eqNullSafe(item)), F.lit(False))


def index_of(x, item) -> Column:
    """The first place of an item; missing without one."""
    return F.nullif(F.array_position(col(x), item), F.lit(0)) - 1


def map(x, f) -> Column:  # noqa: A001
    return F.transform(col(x), f)


def filter(x, f) -> Column:  # noqa: A001
    return F.filter(col(x), lambda e: F.coalesce(f(e), F.lit(False)))


def any(x, f) -> Column:  # noqa: A001
    return F.coalesce(F.exists(col(x), lambda e: F.coalesce(f(e), F.lit(False))), F.lit(False))


def all(x, f) -> Column:  # noqa: A001
    return F.forall(col(x), lambda e: F.coalesce(f(e), F.lit(False)))


def find_first(x, f) -> Column:
    return F.get(filter(x, f), F.lit(0))


def flatmap(x, f) -> Column:
    return F.flatten(F.transform(col(x), f))


def fold(x, zero, f) -> Column:
    return F.aggregate(col(x), zero if isinstance(zero, Column) else F.lit(zero), f)


def array_scan(x, zero, f) -> Column:
    """All running values of a fold, the first is zero."""
    zero = zero if isinstance(zero, Column) else F.lit(zero)
    return F.aggregate(col(x), F.array(zero), lambda a, e: F.concat(a, F.array(f(F.element_at(a, -1), e))))


def group_array(x, f) -> Column:
    """Map from f's values to the elements that have them."""
    x = col(x)
    keys = F.array_distinct(F.transform(x, f))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(x, lambda e: f(e) == k)))


def zip_arrays(*xs, fill_missing: bool = False) -> Column:
    """Tuples by position, of the shortest length or, filled with missing values, of the longest."""
    names = [f"_{i}" for i in range(len(xs))]
    zipped = F.arrays_zip(*[col(x).alias(n) for x, n in zip(xs, names, strict=True)])
    zipped = F.transform(zipped, lambda s: F.struct(*[s[n].alias(n) for n in names]))
    return zipped if fill_missing else F.slice(zipped, F.lit(1), F.least(*[F.size(col(x)) for x in xs]) if len(xs) > 1 else F.size(col(xs[0])))


def enumerate_array(x, start: int = 0) -> Column:
    return F.transform(col(x), lambda e, i: F.struct((i + start).alias("_0"), e.alias("_1")))


def grouped(x, size: int) -> Column:
    x = col(x)
    n = F.ceil(F.size(x) / size).cast("int")
    return F.transform(number_range(F.lit(0), n), lambda i: F.slice(x, i * size + 1, size))


def sorted(x, key=None, reverse: bool = False) -> Column:  # noqa: A001
    """Missing values last either way."""
    x = col(x)
    key = key or (lambda e: e)
    rows = F.transform(x, lambda e: F.struct(key(e).alias("k"), e.alias("e")))
    some = F.sort_array(F.filter(rows, lambda r: r["k"].isNotNull()), not reverse)
    return F.transform(F.concat(some, F.filter(rows, lambda r: r["k"].isNull())), lambda r: r["e"])


def numbers(x) -> Column:
    return F.filter(col(x), lambda e: e.isNotNull())


def sum(x) -> Column:  # noqa: A001
    """Missing elements are left out; 0 for none."""
    return F.aggregate(numbers(x), F.lit(0.0), lambda a, e: a + e)


def product(x) -> Column:
    return F.aggregate(numbers(x), F.lit(1.0), lambda a, e: a * e)


def mean(x) -> Column:
    return divide(sum(x), F.size(numbers(x)))


def median(x) -> Column:
    """The middle element, the mean of two in the middle; missing elements are left out."""
    s = F.array_sort(numbers(x))
    n = F.size(s)
    at = lambda i: F.get(s, i.cast("int"))
    return F.when(n == 0, None).otherwise((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def array_min(x) -> Column:
    """NaN if an element is."""
    x = col(x)
    return F.when(F.exists(x, lambda e: F.coalesce(F.isnan(e.cast("double")), F.lit(False))), F.lit(NAN)).otherwise(F.array_min(x))


def array_max(x) -> Column:
    x = col(x)
    return F.when(F.exists(x, lambda e: F.coalesce(F.isnan(e.cast("double")), F.lit(False))), F.lit(NAN)).otherwise(F.array_max(x))


def nanmin(x) -> Column:
    return F.array_min(F.filter(col(x), lambda e: ~F.isnan(e)))


def nanmax(x) -> Column:
    return F.array_max(F.filter(col(x), lambda e: ~F.isnan(e)))


def cumulative_sum(x) -> Column:
    return F.slice(array_scan(x, F.lit(0.0), lambda a, e: a + e), F.lit(2), F.size(col(x)))


def argmin(x) -> Column:
    """The first place of the smallest element."""
    return index_of(x, F.array_min(col(x)))


def argmax(x) -> Column:
    return index_of(x, F.array_max(col(x)))


def unique_min_index(x) -> Column:
    x = col(x)
    return F.when(F.size(F.filter(x, lambda e: e == F.array_min(x))) == 1, argmin(x))


def unique_max_index(x) -> Column:
    x = col(x)
    return F.when(F.size(F.filter(x, lambda e: e == F.array_max(x))) == 1, argmax(x))


def array_op(a, b, f) -> Column:
    """f by position of two arrays, or of an array and a number."""
    return F.zip_with(col(a), b, f) if isinstance(b, Column) else F.transform(col(a), lambda e: f(e, F.lit(b)))


def binary_search(x, item) -> Column:
    """How many elements of a sorted array are smaller."""
    return F.size(F.filter(col(x), lambda e: e < item))


def keyed_intersection(arrays: list, key: str) -> Column:
    """Of arrays of structs sorted by key: for each key in all of them, the array of their elements."""
    cs = [col(a) for a in arrays]
    keys = F.transform(cs[0], lambda e: e[key])
    for c in cs[1:]:
        keys = F.array_intersect(keys, F.transform(c, lambda e: e[key]))
    return F.transform(F.array_sort(keys), lambda k: F.array(*[F.get(F.filter(c, lambda e: e[key] == k), F.lit(0)) for c in cs]))


def keyed_union(arrays: list, key: str) -> Column:
    cs = [col(a) for a in arrays]
    keys = F.transform(cs[0], lambda e: e[key])
    for c in cs[1:]:
        keys = F.array_union(keys, F.transform(c, lambda e: e[key]))
    return F.transform(F.array_sort(keys), lambda k: F.array(*[F.get(F.filter(c, lambda e: e[key] == k), F.lit(0)) for c in cs]))


# sets: sorted arrays of distinct values


def to_set(x) -> Column:
    return F.array_sort(F.array_distinct(col(x)))


def add(x, item) -> Column:
    return to_set(F.array_append(col(x), item))


def remove(x, item) -> Column:
    return F.array_remove(col(x), item)


def union(a, b) -> Column:
    return F.array_sort(F.array_union(col(a), col(b)))


def intersection(a, b) -> Column:
    return F.array_sort(F.array_intersect(col(a), col(b)))


def difference(a, b) -> Column:
    return F.array_sort(F.array_except(col(a), col(b)))


def symmetric_difference(a, b) -> Column:
    return union(F.array_except(col(a), col(b)), F.array_except(col(b), col(a)))


def is_subset(a, b) -> Column:
    return F.size(F.array_except(col(a), col(b))) == 0


# dicts


def dict_get(d, key, default=None) -> Column:
    found = F.try_element_at(col(d), key if isinstance(key, Column) else F.lit(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def dict_keys(d) -> Column:
    return F.array_sort(F.map_keys(col(d)))


def dict_items(d) -> Column:
    return F.array_sort(F.map_entries(col(d)))


def map_values(d, f) -> Column:
    return F.transform_values(col(d), lambda _, v: f(v))


def to_dict(entries) -> Column:
    """A dict of struct<key, value> entries; of several for one key the last counts."""
    entries = col(entries)
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


# structs


def annotate_struct(s, **named) -> Column:
    out = col(s)
    for k, v in named.items():
        out = out.withField(k, col(v))
    return out


def select_fields(s, *names: str) -> Column:
    return F.struct(*[col(s)[n].alias(n) for n in names])


def drop_fields(s, *names: str) -> Column:
    return col(s).dropFields(*names)


# random values: seeded hashes of a key, so that recomputed rows keep their values


def rand_unif(key, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Column:
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), col(key)), 11) / F.lit(float(1 << 53))
    return low + (high - low) * u


def rand_bool(key, p: float, seed: int = 0) -> Column:
    return rand_unif(key, seed=seed) < p


def rand_norm(key, mean: float = 0.0, sd: float = 1.0, seed: int = 0) -> Column:
    u, v = rand_unif(key, seed=seed), rand_unif(key, seed=seed + 1)
    return mean + sd * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def rand_cat(key, weights: list[float], seed: int = 0) -> Column:
    """A place of the list, by weight."""
    total, done, u = 0.0, 0.0, rand_unif(key, seed=seed)
    for w in weights:
        total += w
    out = F.lit(len(weights) - 1)
    steps = []
    for i, w in enumerate(weights[:-1]):
        done += w
        steps.append((i, done / total))
    for i, edge in reversed(steps):
        out = F.when(u < edge, F.lit(i)).otherwise(out)
    return out


def rand_int(key, low: int, high: int, seed: int = 0) -> Column:
    return (F.floor(rand_unif(key, low, high, seed))).cast("bigint")
