"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs (lines and sentences, and the pieces of long runs without an end) are digested to 64 bits: 48 of a hash and 16 that check
it.  Each distinct digest goes into one cell of each of three subtables, and a cell holds the XOR of its digests.
Subtracting one version's cells from another's, by XOR, cancels what both hold.  Peeling then takes cells that hold one
digest (its check fits, and it belongs into that cell), removes that digest from its other cells and goes on until
nothing is left, which recovers the differing digests.  If it sticks, the sketch was too small and a four times larger
one is tried, until one succeeds.

A fingerprint is a sketch with room for 16 times a text's digests, and depends on the text alone.  Two fingerprints are
compared by subtraction and peeling: the smaller one is brought to the size of the larger first, and if peeling sticks,
both are brought to the next size.  Two subtables nearly always suffice (:func:`with_peeled`); else all three are peeled.  A document sends the one before nothing but its fingerprint, of the first size from
which its digests can be listed, and the characters that the edited text needs; the returned strings give the same
likeness again (:func:`read`, :func:`with_likeness`).

Defined results: null counts as the empty text, which has no paragraphs and likeness 1 to another such text and 0 to
any other; repeated paragraphs count once; a table of one document has itself as next; rows of one doc_id share the
document before them, which sees the first text of them in the order of hashes; a null doc_id comes first, together with
the least long; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.neighbours import with_next
from shelfspark.llm.skew import SHARE

#: Each size of the ladder is four times the one before; the last is beyond what any text can need.
TRIES = 14
LEAST_CELLS = 64
#: If a text has more characters, all are compared in few projections: some dozens, each holding such a row, need too much memory.
WIDE = 1 << 18
CHECK = 0xFFFF


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def checked(hashed: Column) -> Column:
    """The digest of a 64-bit hash: its upper 48 bits, then 16 bits that check them."""
    high = hashed.bitwiseAND(F.lit(~CHECK))
    return high.bitwiseOR(F.xxhash64(high).bitwiseAND(F.lit(CHECK)))


#: White space after a sentence end, with closing quotes or brackets, in scripts that write it, and every line break.
ENDS = r"\s(?:(?<=[.!?\u2026\u061F\u06D4\u0964\u0965\u0589\u1362][\)\]\"'\u00BB\u201D\u2019]?\s)\s*|(?<=[\r\n])[\r\n]*)"
#: Sentence ends of scripts that write no white space after them.
CLOSERS = "\u3002\uFF01\uFF1F\uFF61"
CLOSE = f"([{CLOSERS}])"
#: Longer runs without an end are cut after words whose hash is a multiple of 8, and after 32 words at most.
LONG = 240


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs, which end at every line break and every sentence end."""

    def pieces(p: Column) -> Column:
        def cut(w: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i % 32 == 0) | (F.pmod(F.xxhash64(F.get(w, i - 1)), F.lit(8)) == 0))
            return let(starts, lambda s: F.transform(s, lambda at, i: F.array_join(F.slice(w, at + 1, F.coalesce(F.get(s, i + 1), F.size(w)) - at), " ")))

        return F.when(F.char_length(p) <= LONG, F.array(p)).otherwise(let(F.regexp_extract_all(p, F.lit(r"(\S{1,64})"), F.lit(1)), cut))

    closed = F.when(reduce(or_, (F.contains(text, F.lit(c)) for c in CLOSERS)), F.regexp_replace(text, CLOSE, "$1\n")).otherwise(text)
    # most texts have no long run; bytes are counted first, as that takes no look at the text
    is_long = lambda p: (F.octet_length(p) > LONG) & (F.char_length(F.trim(p)) > LONG)
    short = lambda parts: F.when(F.exists(parts, is_long), F.flatten(F.transform(parts, lambda p: pieces(F.trim(p))))).otherwise(parts)
    # each step's result is copied, so the texts go into one step only
    hashed = let(F.split(closed, ENDS), lambda parts: F.transform(short(parts), lambda p: F.xxhash64(F.trim(p))))
    return F.array_remove(F.array_distinct(F.transform(hashed, checked)), checked(F.xxhash64(F.lit(""))))


def cell_of(key: Column, j: int, size: Column) -> Column:
    """The place of a digest's cell in subtable ``j``: the digest's bits from 16 j on; the subtables' cells follow each other."""
    return F.shiftrightunsigned(key, 16 * j).bitwiseAND(size - 1) + size * j


def _places(keys: Column, size: Column, base: Column) -> Column:
    """For each digest and subtable its cell in the upper half of a long, and the digest's number from ``base``."""
    one = lambda j: F.transform(keys, lambda k, i: F.shiftleft(cell_of(k, j, size), 32).bitwiseOR((i + base).cast("long")))
    return F.concat(*map(one, range(3)))


def _all_places(keys: Column) -> Column:
    """As :func:`_places` from 0, of a size whose ``size - 1`` is the column ``_mask``."""
    mask = F.col("_mask")
    one = lambda j: F.transform(keys, lambda k, i: F.shiftleft(F.shiftrightunsigned(k, 16 * j).bitwiseAND(mask) + (mask + 1) * j if j else k.bitwiseAND(mask), 32).bitwiseOR(i.cast("long")))
    return F.concat(*map(one, range(3)))


def _gathered(places: Column, keys: Column) -> Column:
    """Cells (c, k) with the XOR k of the keys that fall into cell c; empty cells are left out."""

    empty = F.array().cast("array<struct<c:bigint,k:bigint>>")

    def of(e: Column) -> Column:
        cell = lambda i: F.shiftrightunsigned(F.get(e, i), 32)
        starts = F.filter(F.sequence(F.lit(0), F.size(e) - 1), lambda i: (i == 0) | (cell(i) != cell(i - 1)))

        def cells(s: Column) -> Column:
            key = lambda p: F.get(keys, p.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
            total = lambda at, n: F.when(n == 1, key(F.get(e, at))).otherwise(F.aggregate(F.slice(e, at + 1, n), F.lit(0).cast("long"), lambda x, p: x.bitwiseXOR(key(p))))
            whole = F.transform(s, lambda at, i: F.struct(cell(at).alias("c"), total(at, F.coalesce(F.get(s, i + 1), F.size(e)) - at).alias("k")))
            return F.filter(whole, lambda x: x["k"] != 0)

        return F.when(F.size(e) == 0, empty).otherwise(let(starts, cells))

    return let(F.sort_array(places), of)


def with_cells(rows: DataFrame, name: str, places: Column, keys: str) -> DataFrame:
    """``rows`` with the cells of :func:`_gathered` as two arrays, ``<name>_c`` and ``<name>_k``.

    Each step is a column of its own, so that Spark sorts and compares whole arrays of longs in compiled code.
    """
    c, k = f"{name}_c", f"{name}_k"
    rows = rows.withColumn("_e", F.sort_array(places))
    rows = rows.withColumns({"_cell": F.transform("_e", lambda x: F.shiftrightunsigned(x, 32)), "_v": F.transform("_e", lambda x: F.get(F.col(keys), x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")))})
    rows = rows.withColumn(c, F.array_distinct("_cell"))
    shared = F.size(c) < F.size("_cell")
    more = F.filter(F.sequence(F.lit(1), F.size("_cell") - 1), lambda i: F.get("_cell", i) == F.get("_cell", i - 1))
    rows = rows.withColumn("_s", F.when(shared, F.array_except(F.sequence(F.lit(0), F.size("_cell") - 1), more)))
    until = lambda i: F.coalesce(F.get("_s", i + 1), F.size("_cell"))
    xor = lambda at, i: F.aggregate(F.slice("_v", at + 1, until(i) - at), F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x))
    total = F.transform("_s", lambda at, i: F.when(until(i) == at + 1, F.get("_v", at)).otherwise(xor(at, i)))
    rows = rows.withColumn(k, F.when(shared, total).otherwise(F.col("_v")))
    empty = shared & F.array_contains(k, F.lit(0).cast("long"))
    rows = rows.withColumn("_c", F.when(empty, F.filter(c, lambda x, i: F.get(k, i) != 0)).otherwise(F.col(c)))
    return rows.withColumns({c: F.col("_c"), k: F.when(empty, F.filter(k, lambda x: x != 0)).otherwise(F.col(k))}).drop("_e", "_cell", "_v", "_s", "_c")


def with_peeled(rows: DataFrame, name: str, cells: str, size: str) -> DataFrame:
    """``rows`` with the digests that the cells ``<cells>_c, <cells>_k`` hold, listed from the first two subtables; null if they don't tell.

    Cells of either subtable that hold one digest give it.  The second one's digests are removed from those cells of the
    first that hold more, which are then empty or hold one digest.  If any other is left, or a digest of the second
    subtable lies in no such cell, more has to be peeled.
    """
    c, k, m = F.col(f"{cells}_c"), F.col(f"{cells}_k"), F.col(size)
    mask = F.col("_mask")
    fits = lambda x: F.xxhash64(x.bitwiseAND(F.lit(~CHECK))).bitwiseXOR(x).bitwiseAND(F.lit(CHECK)) == 0
    place = lambda x, i: F.shiftleft(x, 32).bitwiseOR(i.cast("long"))
    rows = rows.withColumns({"_mask": m - 1, "_n0": F.size(F.filter(c, lambda x: x < m)), "_n1": F.size(F.filter(c, lambda x: x < 2 * m))})
    rows = rows.withColumns({"_c0": F.slice(c, F.lit(1), F.col("_n0")), "_k0": F.slice(k, F.lit(1), F.col("_n0"))})
    rows = rows.withColumns({"_c1": F.slice(c, F.col("_n0") + 1, F.col("_n1") - F.col("_n0")), "_k1": F.slice(k, F.col("_n0") + 1, F.col("_n1") - F.col("_n0"))})
    rows = rows.withColumn("_f0", F.filter("_k0", lambda x, i: (x.bitwiseXOR(F.get("_c0", i)).bitwiseAND(mask) == 0) & fits(x)))
    second = F.filter("_k1", lambda x, i: (F.shiftrightunsigned(x, 16).bitwiseXOR(F.get("_c1", i)).bitwiseAND(mask) == 0) & fits(x))
    first = lambda found: F.transform(found, lambda x: x.bitwiseAND(mask))
    rows = rows.withColumns({"_lc": F.array_except("_c0", first("_f0")), "_lk": F.array_except("_k0", "_f0"), "_f1": F.array_except(second, "_f0")})
    rows = rows.withColumn("_lv", F.concat("_lk", "_f1"))
    left = F.concat(F.transform("_lc", place), F.transform("_f1", lambda x, i: place(x.bitwiseAND(mask), i + F.size("_lc"))))
    rows = rows.withColumn("_g", _gathered(left, F.col("_lv")))
    rows = rows.withColumn("_f2", F.filter("_g", lambda x: (x["k"].bitwiseAND(mask) == x["c"]) & fits(x["k"])))
    whole = (F.size("_f2") == F.size("_g")) & (F.size(F.array_except(first("_f1"), "_lc")) == 0)
    rows = rows.withColumn(name, F.when(whole, F.concat("_f0", "_f1", F.transform("_f2", lambda x: x["k"]))))
    return rows.drop("_mask", "_n0", "_n1", "_c0", "_k0", "_c1", "_k1", "_f0", "_f1", "_f2", "_lc", "_lk", "_lv", "_g")


def sketch(keys: Column, size: Column) -> Column:
    """The cells of these digests."""
    return _gathered(_places(keys, size, F.lit(0)), keys)


def subtracted(a: Column, b: Column) -> Column:
    """The cells of one sketch less those of another of the same size."""
    at = lambda x, i: F.shiftleft(x["c"], 32).bitwiseOR(i.cast("long"))
    return let(F.concat(a, b), lambda cells: let(F.transform(cells, lambda x: x["k"]), lambda keys: _gathered(F.transform(cells, at), keys)))


def peeled(cells: Column, size: Column, rounds: int = 60) -> Column:
    """``ok, found``: the digests that the cells hold, and whether all could be recovered."""
    xor = lambda keys, start: F.aggregate(keys, start, lambda x, k: x.bitwiseXOR(k))
    # the cells of one subtable hold every digest once, so what is left of their XOR tells whether all have been found
    whole = F.aggregate(cells, F.lit(0).cast("long"), lambda t, x: F.when(x["c"] < size, t.bitwiseXOR(x["k"])).otherwise(t))
    step = lambda cells, found, left, going, ok: F.struct(cells.alias("cells"), found.alias("found"), left.alias("left"), going.alias("going"), ok.alias("ok"))

    def pure(x: Column) -> Column:
        k = x["k"]
        fits = F.xxhash64(k.bitwiseAND(F.lit(~CHECK))).bitwiseAND(F.lit(CHECK)) == k.bitwiseAND(F.lit(CHECK))
        at = F.when(x["c"] < size, cell_of(k, 0, size)).when(x["c"] < 2 * size, cell_of(k, 1, size)).otherwise(cell_of(k, 2, size))
        return fits & (at == x["c"])

    def rest(s: Column, new: Column) -> Column:
        here = F.transform(s["cells"], lambda x, i: F.shiftleft(x["c"], 32).bitwiseOR(i.cast("long")))
        return let(F.concat(F.transform(s["cells"], lambda x: x["k"]), new), lambda keys: _gathered(F.concat(here, _places(new, size, F.size(s["cells"]))), keys))

    def turn(s: Column) -> Column:
        def after(new: Column) -> Column:
            found, left = F.concat(s["found"], new), xor(new, s["left"])
            last = F.lit(False)
            return F.when(left == 0, step(s["cells"], found, left, last, F.lit(True))).when(F.size(new) == 0, step(s["cells"], found, left, last, last)).otherwise(step(rest(s, new), found, left, F.lit(True), last))

        return let(F.array_distinct(F.transform(F.filter(s["cells"], pure), lambda x: x["k"])), after)

    start = step(cells, F.array().cast("array<bigint>"), whole, F.size(cells) > 0, F.size(cells) == 0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: F.when(s["going"], turn(s)).otherwise(s), lambda s: F.struct(s["ok"].alias("ok"), s["found"].alias("found")))


def _grown(least: Column, t: Column) -> Column:
    return F.call_function("shiftleft", least, 2 * t)


def _first_whole(attempt: Callable[[Column], Column], kind: str, tries: Column) -> Column:
    """The first of the attempts 0, 1, ... (structs with ``ok``) that succeeds; the sizes grow until one does."""
    return F.aggregate(tries, F.lit(None).cast(kind), lambda s, t: F.when(s["ok"], s).otherwise(attempt(t)), lambda s: F.when(s["ok"], s).otherwise(F.raise_error(F.lit("no sketch could be peeled")).cast(kind)))


def _cells(f: Column) -> Column:
    return F.arrays_zip(f["c"], f["k"]).cast("array<struct<c:bigint,k:bigint>>")


def with_fingerprint(rows: DataFrame, name: str, keys: str, first: int = LEAST_CELLS, room: int = 16, listable: bool = True, lean: bool = False) -> DataFrame:
    """``rows`` with the fingerprint of distinct digests: ``n`` of them, ``m`` cells a subtable, their places and contents.

    ``m`` is the first of a power of two of at least ``room`` times ``n`` (and ``first``), four times it, and so on, from which all
    digests can be listed.  So nearly all digests are alone in a cell and peeling takes one turn or two; room costs
    little, as empty cells are left out.  If not ``listable`` the first size is taken unseen, for rows that keep their
    digests at hand.  ``lean`` takes few projections, each of which holds a whole row, and more time.
    """
    kind = "struct<ok:boolean,m:bigint,cells:array<struct<c:bigint,k:bigint>>>"
    d = F.col(keys)
    rows = rows.withColumn("_m", F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.greatest(F.size(d) * room, F.lit(first)))).cast("int")))

    def attempt(t: Column) -> Column:
        m = _grown(F.col("_m"), t)
        return let(sketch(d, m), lambda cells: F.struct(peeled(cells, m)["ok"].alias("ok"), m.alias("m"), cells.alias("cells")))

    if lean:
        unseen = F.struct(F.lit(True).alias("ok"), F.col("_m").alias("m"), sketch(d, F.col("_m")).alias("cells"))
        rows = rows.withColumn("_s", unseen.cast(kind) if not listable else _first_whole(attempt, kind, F.sequence(F.lit(0), F.lit(TRIES - 1))))
        return rows.withColumn(name, F.struct(F.size(d).alias("n"), F.col("_s.m").alias("m"), F.col("_s.cells.c").alias("c"), F.col("_s.cells.k").alias("k"))).drop("_m", "_s")
    rows = with_cells(rows.withColumn("_mask", F.col("_m") - 1), "_u", _all_places(d), keys).drop("_mask")
    if listable:
        rows = with_peeled(rows, "_p", "_u", "_m")
        rows = rows.withColumn("_s", F.when(F.col("_p").isNull(), _first_whole(attempt, kind, F.sequence(F.lit(0), F.lit(TRIES - 1))))).drop("_p")
        seen = [F.coalesce(F.col(f"_s.{x}"), F.col(y)) for x, y in (("m", "_m"), ("cells.c", "_u_c"), ("cells.k", "_u_k"))]
    else:
        seen = [F.col(x) for x in ("_m", "_u_c", "_u_k")]
    return rows.withColumn(name, F.struct(F.size(d).alias("n"), *(x.alias(y) for x, y in zip(seen, "mck", strict=True)))).drop("_m", "_s", "_u_c", "_u_k")


def with_likeness(rows: DataFrame, name: str, a: str, b: str, a_keys: str | None = None, b_keys: str | None = None, lean: bool = False) -> DataFrame:
    """``rows`` with the shared digests over all digests of two fingerprints; 1 for two empty ones.

    The smaller one is brought to the size of the larger, both are subtracted and the difference is peeled.  If that
    sticks, both are brought to four times the size, and so on.  To bring a fingerprint to another size its digests are
    listed, unless they are at hand in the column ``a_keys`` or ``b_keys``.  ``lean`` as in :func:`with_fingerprint`.
    """
    kind = "struct<ok:boolean,found:array<bigint>>"
    f, g, size = F.col(a), F.col(b), F.col("_m")
    both = (f["n"] > 0) & (g["n"] > 0)  # nothing is compared if either is empty
    listed = lambda x, keys, when: F.when(when, F.col(keys) if keys else peeled(_cells(x), x["m"])["found"])
    rows = rows.withColumn("_m", F.greatest(f["m"], g["m"]))
    if lean:
        rows = rows.withColumns({"_a": listed(f, a_keys, both & (f["m"] < size)), "_b": listed(g, b_keys, both & (g["m"] < size))})
        at = lambda x, keys: F.when(F.col(keys).isNull(), _cells(x)).otherwise(sketch(F.col(keys), size))
        rows = rows.withColumn("_x", F.when(both, subtracted(at(f, "_a"), at(g, "_b"))))
        rows = rows.withColumn("_p", F.when(both, peeled(F.col("_x"), size)))
        rows, more = rows.withColumn("_y", F.lit(None).cast("array<bigint>")), both
    else:
        small = {"_a": both & (f["m"] < size), "_b": both & (g["m"] < size)}
        for x, side, at_hand in (("_a", a, a_keys), ("_b", b, b_keys)):
            if at_hand:
                rows = rows.withColumn(x, F.when(small[x], F.col(at_hand)))
            else:
                rows = rows.withColumns({f"_w{i}": F.when(small[x], F.col(side)[i]) for i in "mck"}).withColumnsRenamed({"_wc": "_w_c", "_wk": "_w_k"})
                rows = with_peeled(rows, x, "_w", "_wm")
                rows = rows.withColumn(x, F.coalesce(x, listed(F.col(side), None, small[x]))).drop("_wm", "_w_c", "_w_k")
        # the first two subtables; a digest of a listed side counts as a cell that holds it
        here = lambda keys: F.concat(F.transform(keys, lambda k: cell_of(k, 0, size)), F.transform(keys, lambda k: cell_of(k, 1, size)))
        near = lambda x, i, side: F.slice(F.col(side)[i], F.lit(1), F.col(f"{x}_n"))
        sides = (("_a", a), ("_b", b))
        rows = rows.withColumns({f"{x}_n": F.size(F.filter(F.col(side)["c"], lambda c: c < 2 * size)) for x, side in sides})
        rows = rows.withColumns({"_xc": F.when(both, F.concat(*(F.when(small[x], here(F.col(x))).otherwise(near(x, "c", side)) for x, side in sides))), "_xk": F.when(both, F.concat(*(F.when(small[x], F.concat(x, x)).otherwise(near(x, "k", side)) for x, side in sides)))})
        rows = with_cells(rows, "_x", F.transform("_xc", lambda c, i: F.shiftleft(c, 32).bitwiseOR(i.cast("long"))), "_xk")
        rows = with_peeled(rows, "_y", "_x", "_m").drop("_xc", "_xk", "_x_c", "_x_k", "_a_n", "_b_n")
        # what two subtables don't tell
        at = lambda x, keys: F.when(F.col(keys).isNull(), _cells(x)).otherwise(sketch(F.col(keys), size))
        more = both & F.col("_y").isNull()
        rows = rows.withColumn("_x", F.when(more, subtracted(at(f, "_a"), at(g, "_b"))))
        rows = rows.withColumn("_p", F.when(more, peeled(F.col("_x"), size)))
    stuck = more & ~F.col("_p.ok")
    rows = rows.withColumns({"_a": F.when(stuck, F.coalesce("_a", listed(f, a_keys, stuck))), "_b": F.when(stuck, F.coalesce("_b", listed(g, b_keys, stuck)))})

    def attempt(t: Column) -> Column:
        m = _grown(size, t)
        return let(subtracted(sketch(F.col("_a"), m), sketch(F.col("_b"), m)), lambda cells: peeled(cells, m))

    rows = rows.withColumn("_q", F.when(stuck, _first_whole(attempt, kind, F.sequence(F.lit(1), F.lit(TRIES - 1)))))
    n, d = f["n"] + g["n"], F.size(F.coalesce(F.col("_q.found"), F.col("_y"), F.col("_p.found")))
    like = F.when(n == 0, F.lit(1.0)).when(~both, F.lit(0.0)).otherwise((n - d) / (n + d))
    # the guard is always true; as it isn't deterministic, a filter on the likeness is not copied down into every sketch
    return rows.withColumn(name, F.when(F.rand(0) >= 0, like)).drop("_m", "_a", "_b", "_x", "_y", "_p", "_q")


def written(f: Column) -> Column:
    """A fingerprint as text: ``n``, ``m``, and each cell that is not empty as its place and content, in hexadecimal."""
    cells = F.transform(f["c"], lambda c, i: F.concat(F.hex(c), F.lit(":"), F.hex(F.get(f["k"], i))))
    return F.lower(F.concat_ws(";", F.hex(f["n"].cast("long")), F.hex(f["m"]), F.array_join(cells, ",")))


def read(text: Column) -> Column:
    """The fingerprint that :func:`written` gave as text."""
    number = lambda h: F.conv(h, 16, -10).cast("long")
    part = lambda i: F.get(F.split(text, ";"), F.lit(i))
    cells = F.filter(F.split(part(2), ","), lambda x: x != "")
    half = lambda i: F.transform(cells, lambda x: number(F.get(F.split(x, ":"), F.lit(i))))
    return F.struct(number(part(0)).cast("int").alias("n"), number(part(1)).alias("m"), half(0).alias("c"), half(1).alias("k"))


def edited_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digests: Callable[[Column], Column] = digests) -> DataFrame:
    """``doc_id, text, edited, after`` of :func:`_pairs`."""
    return _pairs(docs, id_col, text_col, digests)[0]


def _pairs(docs: DataFrame, id_col: str, text_col: str, digests: Callable[[Column], Column]) -> tuple[DataFrame, bool]:
    """``doc_id, text, edited, after``: every text, its edited form and the fingerprint of the next document.

    The edited form has its last quarter of code points replaced by as many first ones of the next document (or all).
    The documents are shuffled once, by id; what a document gives to the one before is its fingerprint and the piece that
    the edited text needs.  An id of more than 1/1024 of all rows is dealt over parts, each of which gets a copy of that.
    Also whether a text is longer than ``WIDE``, so that rows are too large for many projections.
    """
    spark = docs.sparkSession
    least = F.lit(-(2**63)).cast("long")  # a null id comes first
    # the same columns on both ways that the documents go, so that they are shuffled once
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("at", F.coalesce("doc_id", least))
    order = with_next(base.groupBy("at").agg(F.max(F.char_length("text")).alias("n"), F.count("*").alias("rows")), "at")  # at, n, rows, next_key
    total, longest = (x or 0 for x in order.agg(F.sum("rows"), F.max("n")).first())
    lean = longest > WIDE
    heavy = [(r["at"], -(-r["rows"] * SHARE // total)) for r in order.where(F.col("rows") * SHARE > total).where("rows > 1").select("at", "rows").collect()]  # fewer than SHARE ids
    asked = order.select(F.col("next_key").alias("at"), F.col("at").alias("before"), F.floor(F.col("n") / 4).cast("int").alias("need"))

    def given(first: DataFrame) -> DataFrame:
        """What the texts ``first`` (one an id) give to the ids before them."""
        return with_fingerprint(first.withColumn("keys", digests(F.col("text"))), "after", "keys", lean=lean).select(F.col("before").alias("at"), F.expr("substring(text, 1, need)").alias("head"), "after")

    def edited(joined: DataFrame) -> DataFrame:
        n = F.char_length("text")
        cut = F.floor(n / 4).cast("int")
        return joined.select("doc_id", "text", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("head", F.lit(1), cut)).alias("edited"), "after")

    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "before", "need", "doc_id")).alias("x")  # all columns, so that both ways share one shuffle
    if not heavy:
        known = base.join(asked, "at")
        return edited(known.join(given(known.groupBy("at").agg(one).select("x.text", "x.before", "x.need", "x.doc_id")), "at")), lean
    parts = F.broadcast(spark.createDataFrame(heavy, "at long, parts int"))
    known = base.join(parts.select("at"), "at", "left_anti").join(asked, "at")
    alone = base.join(parts, "at")
    firsts = alone.groupBy("at").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("y")).join(asked, "at").select("y.text", "before", "need")
    gifts = given(known.groupBy("at").agg(one).select("x.text", "x.before", "x.need").unionByName(firsts))
    dealt = alone.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int")).drop("parts")
    copies = gifts.join(parts, "at").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return edited(known.join(gifts, "at")).unionByName(edited(dealt.join(copies, ["at", "part"]))), lean


def compare_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digests: Callable[[Column], Column] = digests) -> DataFrame:
    """Fingerprints of every text and its edited form, and the text's likeness to that and to the next document."""
    rows, lean = _pairs(docs, id_col, text_col, digests)
    rows = rows.withColumns({"keys": digests(F.col("text")), "edited_keys": digests(F.col("edited"))})
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "keys", "edited_keys", "after")
    rows = with_fingerprint(with_fingerprint(rows, "own", "keys", listable=False, lean=lean), "other", "edited_keys", listable=False, lean=lean)
    rows = with_likeness(with_likeness(rows, "near_edited", "own", "other", "keys", "edited_keys", lean=lean), "near_next", "own", "after", "keys", lean=lean)
    return rows.select("doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"), "near_edited", "near_next")
