"""Near-duplicate lines, in DataFrame operations alone.

Distinct lines within ``THRESHOLD`` edits of each other, and ``PERCENT`` hundredths of the shorter one's characters, are linked by a
join on parts of which one must survive in any line so near. A line is cut into pieces at spaces before certain characters, so that an
edit changes a piece or two neighbours; the ``2 * THRESHOLD + 1`` first ones in an order that all lines share are its keys (a prefix
filter). A line of fewer pieces is cut into THRESHOLD + 1 segments, and its keys are the substrings that are segments, at a place that
lengths and edits bound, of a line so near (segment partition). Lines that meet another one of nearly their length and pieces under a
key are few; of those, the one that occurs most often under each key is compared with the others, and then those that are not in one
component by now with each other, if parities of pairs of characters allow. Pairs are verified by a banded bit-parallel edit distance,
folded over the characters with 64-bit columns. Linked lines form classes; of each class the first occurrence (by document, its text's
hash, line) stays and all others are dropped.

Lines are compared without outer white space; they keep their text. Lines under ``MIN_CHARS`` characters always stay, and those under
``MIN_WORDS`` words only count as repeats where they are equal: both are parameters, and at 0 every line with a character is compared.
Lines more than ``THRESHOLD`` edits apart stay, however long.

Cases: a null or empty text has one empty line and keeps it. Rows with equal id and text are one document: they keep and lose the same
lines. Rows that share an id with different texts are documents of their own, as are rows without an id. Of occurrences in one
document the first line counts. A document of which nothing but white space stays has an empty text. Ids may have any value, lines any
length. An empty table gives no rows. Other input columns pass through ``drop_repeated_lines``, but for ``drops``, which it replaces,
and names that begin with ``__line_``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.llm.common import materialize, table
from provena.llm.components import components

THRESHOLD, PERCENT, MIN_CHARS, MIN_WORDS = 3, 10, 20, 5
_SPACE = " \t\x0b\f\r"
#: A line's pieces end at spaces before one of these characters.
_BREAK = r" +(?=[a-mA-M0-9\x{80}-\x{10FFFF}])"
#: Characters by which lengths are told apart in the keys of pieces.
_STEP = 32


def worded(line: Column, words: int) -> Column:
    """Whether a line without outer white space has so many words."""
    return line.rlike(r"^(?:\S++\s++){%d}\S" % (words - 1)) if words > 1 else line != ""


def trimmed(line: Column) -> Column:
    """``line`` without outer white space. Spaces go first: few lines have others, and for those a slower search follows."""
    line = F.trim(line)
    other = [end(line, F.lit(c)) for end in (F.startswith, F.endswith) for c in _SPACE[1:]]
    return F.when(reduce(or_, other), F.btrim(line, F.lit(_SPACE))).otherwise(line)


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, hash, pos, line`` of the lines that are compared; ``hash`` is that of the whole text."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.withColumn("line", trimmed(F.col("line"))).where((F.char_length("line") >= min_chars) & (F.col("line") != ""))


def places(threshold: int) -> list[tuple[int, int, int]]:
    """Where a line may hold the segments of one that is ``less`` shorter: ``segment, less, shift``. Edits before a segment move it,
    and those behind it must still make up the lengths."""
    out = []
    for less in range(threshold + 1):
        for i in range(threshold + 1):
            out += [(i, less, shift) for shift in range(max(-i, less - (threshold - i)), min(i, less + (threshold - i)) + 1)]
    return out


def segment_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """``id, n, sketch, key`` of ``measured`` lines: a row for each of ``places``, whose key is the digest of (length, segment number,
    segment). A line of ``n`` characters has ``threshold + 1`` segments, the last ones a character longer. The places are exploded first:
    one small expression per row compiles well, where one for all of them would not."""
    where = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(less).alias("less"), F.lit(shift).alias("shift")) for i, less, shift in places(threshold)])
    rows = lines.withColumn("wide", F.encode("line", "UTF-32")).select("id", "n", "sketch", "wide", F.explode(where).alias("p"))
    length, i, parts = F.col("n") - F.col("p.less"), F.col("p.i"), threshold + 1
    base, first_longer = F.floor(length / parts).cast("int"), F.lit(parts) - length % parts
    start = i * base + F.greatest(F.lit(0), i - first_longer) + F.col("p.shift")
    size = base + F.when(i >= first_longer, 1).otherwise(0)
    return rows.select("id", "n", "sketch", F.xxhash64(length, i, F.substr("wide", start * 4 + 1, size * 4)).alias("key"))


def measured(lines: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``lines`` with ``n``, the characters, and of their pieces between ``_BREAK``: ``pieces``, how many, ``sketch``, 64 parities of their
    hashes, and ``least``, the first ``2 * threshold + 1`` hashes in an order that takes long pieces first."""
    code = lambda x: F.shiftrightunsigned(F.xxhash64(x), 4).bitwiseOR(F.shiftleft((7 - F.shiftright(F.least(F.octet_length(x), F.lit(31)), 2)).cast("long"), 60))
    one = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    rows = lines.select("*", *([] if "n" in lines.columns else [F.char_length("line").alias("n")]), F.transform(F.split("line", _BREAK), code).alias("codes"))
    flip = F.aggregate("codes", F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(one(h)))
    return rows.select("*", F.size("codes").alias("pieces"), flip.alias("sketch"), F.slice(F.sort_array("codes"), 1, 2 * threshold + 1).alias("least")).drop("codes")


def piece_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """``id, n, sketch, key`` of ``measured`` lines with ``2 * threshold + 1`` pieces or more: a row for each of the least. An edit
    touches a piece or two neighbours, so ``threshold`` of them cannot touch all of these, half of which at least are no neighbours of each
    other. Of two near lines the one whose last code is less keeps such a piece; the other one has it too, and among its least. Lengths go
    into the key in steps of ``_STEP``; a line just above a step is in the one below as well."""
    steps = F.array_distinct(F.array(F.floor(F.col("n") / _STEP), F.floor((F.col("n") - threshold) / _STEP)))
    rows = lines.select("id", "n", "sketch", steps.alias("steps"), F.explode(F.array_distinct("least")).alias("code"))
    rows = rows.select("id", "n", "sketch", "code", F.explode("steps").alias("step"))
    return rows.select("id", "n", "sketch", F.xxhash64("code", "step").alias("key"))


def members(lines: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Of ``measured`` lines: ``key, id, times, n, bits0, bits1`` of those that have a key in common with another one of nearly their length and
    pieces, and their ``id, line``. Any two lines within ``threshold`` edits have a key in common. The rows of the first join are small, and
    it stops at the first match of a row, so a common key makes no more rows than it has."""
    several = 2 * threshold + 1
    keys = piece_keys(lines.where(F.col("pieces") >= several), threshold).union(segment_keys(lines.where(F.col("pieces") < several + threshold), threshold))
    by_length = Window.partitionBy("key").orderBy("n")
    keys = keys.withColumn("before", F.col("n") - F.lag("n").over(by_length)).withColumn("after", F.lead("n").over(by_length) - F.col("n"))
    keys = materialize(keys.where(f"before <= {threshold} or after <= {threshold}").select("key", "id", "n", "sketch"), "keys")
    x, y = keys.alias("x"), keys.alias("y")
    near = (F.abs(F.col("x.n") - F.col("y.n")) <= threshold) & (F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))) <= 3 * threshold)
    found = x.join(y.hint("shuffle_hash"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & near, "left_semi")
    found = materialize(found.select("key", "id").distinct(), "found")
    needed = lines.join(found.select("id").distinct(), "id", "left_semi")
    needed = needed.select("id", "line", "n", F.col("times") if "times" in lines.columns else F.lit(1).alias("times"))
    needed = materialize(needed.select("*", *pair_bits(F.split("line", ""))), "needed")
    found = found.join(needed.drop("line").hint("merge"), "id")
    return materialize(found.select("key", "id", "times", "n", "bits0", "bits1"), "members"), needed.select("id", "line")


def alike(threshold: int, a: str = "a", b: str = "b") -> Column:
    """Whether lengths and parities allow that ``a`` and ``b`` of ``members`` are near."""
    of = lambda c: (F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    flips = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in (of("bits0"), of("bits1"))), F.lit(0))
    n, m = of("n")
    return (F.abs(n - m) <= threshold) & (flips <= 4 * threshold)


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def banded_distance(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of character arrays, ``a`` not longer than ``b`` by more than ``threshold`` either way; any result above
    ``threshold`` means farther. Bit k of a column's vectors stands for the character k - ``threshold`` away from the diagonal. The
    distance along the band's edge never falls, and from its end the corner is at most ``threshold`` and the difference of lengths away,
    so beyond twice the one and the other the rest is passed over."""
    width = 2 * threshold + 1
    mask = (1 << width) - 1
    n, m = F.size(a), F.size(b)
    whole, flip = F.lit(mask).cast("long"), lambda x: x.bitwiseXOR(F.lit(mask).cast("long"))
    init = F.struct(F.lit(mask & ~((1 << threshold) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(threshold).cast("long").alias("d"))

    hopeless = 2 * threshold + m - n

    def step(s: Column, j: Column) -> Column:
        return F.when(s["d"] > hopeless, s).otherwise(moved(s, j))

    def moved(s: Column, j: Column) -> Column:
        c, x = F.get(b, j), F.lit(0).cast("long")
        for k in range(width):
            x = x.bitwiseOR(F.when(F.get(a, j - threshold + k) == c, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        with_x = F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), x.alias("x"))
        d0 = lambda t: (((t["x"].bitwiseAND(t["vp"]) + t["vp"]).bitwiseXOR(t["vp"])).bitwiseOR(t["x"]).bitwiseOR(t["vn"])).bitwiseAND(whole)
        let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

        def with_d0(t: Column) -> Column:
            hp = t["vn"].bitwiseOR(flip(t["d0"].bitwiseOR(t["vp"])))
            hn = t["d0"].bitwiseAND(t["vp"])
            return let(F.struct(t["d0"].alias("d0"), t["d"].alias("d"), hp.alias("hp"), hn.alias("hn")), last)

        def last(t: Column) -> Column:
            shifted = F.shiftright(t["d0"], 1)
            vp = t["hn"].bitwiseOR(flip(shifted.bitwiseOR(t["hp"])))
            vn = shifted.bitwiseAND(t["hp"])
            on_diagonal = F.when(t["d0"].bitwiseAND(F.lit(1 << (width - 1)).cast("long")) != 0, 0).otherwise(1)
            at = F.call_function("shiftleft", F.lit(1).cast("long"), (width - 2 - (j - (n - threshold))).cast("int"))
            below = F.when(t["hp"].bitwiseAND(at) != 0, 1).otherwise(0) - F.when(t["hn"].bitwiseAND(at) != 0, 1).otherwise(0)
            return F.struct(vp.alias("vp"), vn.alias("vn"), (t["d"] + F.when(j < n - threshold, on_diagonal).otherwise(below)).alias("d"))

        return let(with_x, lambda t: let(F.struct(t["vp"].alias("vp"), t["vn"].alias("vn"), t["d"].alias("d"), d0(t).alias("d0")), with_d0))

    return F.aggregate(F.sequence(F.lit(0), m - 1), init, step, lambda s: s["d"])


def shared_prefix(a: Column, b: Column, most: Column) -> Column:
    """Characters, ``most`` at most, with which both lines begin: bit by bit from the highest."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    grown = lambda at, step: F.when((at + step <= most) & (F.substr(a, at + 1, step) == F.substr(b, at + 1, step)), at + step).otherwise(at)
    return F.aggregate(F.filter(steps, lambda step: step <= most), F.lit(0), grown)


def pair_bits(chars: Column) -> list[Column]:
    """128 parities of the hashed pairs of neighbouring characters; an edit flips four at most."""
    codes = F.zip_with(chars, F.slice(chars, 2, F.size(chars)), lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y).bitwiseAND(F.lit(127))))
    one = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(F.lit(63)).cast("int"))
    flip = lambda half: lambda acc, v: F.when(F.shiftright(v, 6) == half, acc.bitwiseXOR(one(v))).otherwise(acc)
    return [F.aggregate(codes, F.lit(0).cast("long"), flip(half)).alias(f"bits{half}") for half in (0, 1)]


def confirmed(pairs: DataFrame, needed: DataFrame, threshold: int, percent: int) -> DataFrame:
    """The ``pairs`` of ids that are within ``threshold`` edits and ``percent`` hundredths of the shorter line's characters."""
    rows = pairs.join(needed.select(F.col("id").alias("a"), F.col("line").alias("la")).hint("merge"), "a")
    rows = rows.join(needed.select(F.col("id").alias("b"), F.col("line").alias("lb")).hint("merge"), "b")
    # the distance takes the shorter one first
    short = F.char_length("la") <= F.char_length("lb")
    rows = rows.select("a", "b", F.when(short, F.col("la")).otherwise(F.col("lb")).alias("la"), F.when(short, F.col("lb")).otherwise(F.col("la")).alias("lb"))
    rows = rows.withColumn("na", F.char_length("la")).withColumn("nb", F.char_length("lb"))
    # equal beginnings and ends take no part; as much of a beginning stays as the band needs
    rows = rows.withColumn("begin", shared_prefix(F.col("la"), F.col("lb"), F.least("na", "nb")))
    rows = rows.withColumn("end", shared_prefix(F.reverse("la"), F.reverse("lb"), F.least("na", "nb") - F.greatest(F.col("begin"), F.lit(threshold + 5)))).withColumn("begin", F.greatest(F.lit(0), F.col("begin") - threshold - 5))
    middle = lambda line, n: F.split(F.substr(line, F.col("begin") + 1, F.col(n) - F.col("begin") - F.col("end")), "")
    # written first: the fold would else make them anew for each character
    rows = materialize(rows.select("a", "b", "na", middle("la", "na").alias("ca"), middle("lb", "nb").alias("cb")), "middles")
    most = F.least(F.lit(threshold), F.floor(F.col("na") * percent / 100))
    return materialize(rows.where(banded_distance(F.col("ca"), F.col("cb"), threshold) <= most).select("a", "b"), "links")


def met(rows: DataFrame, threshold: int, also: Column) -> DataFrame:
    """The distinct pairs ``a, b`` of ``members`` with a key in common that may be near."""
    pairs = rows.alias("a").join(rows.alias("b").hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & also & alike(threshold))
    return materialize(pairs.select(*ordered("a.id", "b.id")).distinct(), "pairs")


def links(lines: DataFrame, threshold: int = THRESHOLD, percent: int = PERCENT) -> DataFrame:
    """All pairs ``a, b`` of ids of ``lines`` (of ``measured``) within ``threshold`` edits and ``percent`` hundredths of the
    shorter one's characters."""
    rows, needed = members(measured(lines.select("id", "line"), threshold), threshold)
    return confirmed(met(rows, threshold, F.lit(True)), needed, threshold, percent)


def classes(lines: DataFrame, threshold: int = THRESHOLD, percent: int = PERCENT) -> DataFrame:
    """``node, component`` of the ``measured`` lines that ``links`` links, without all of its pairs: the lines of a key first meet its leader, the
    one that occurs most often; then those that are in different components by now meet each other."""
    rows, needed = members(lines, threshold)
    first = rows.groupBy("key").agg(F.max_by(F.struct("id", "n", "bits0", "bits1"), F.struct("times", "id")).alias("b")).withColumnRenamed("key", "of")
    pairs = rows.alias("a").join(first.hint("merge"), (F.col("a.key") == F.col("of")) & (F.col("a.id") != F.col("b.id")) & alike(threshold))
    led = confirmed(materialize(pairs.select(*ordered("a.id", "b.id")).distinct(), "pairs"), needed, threshold, percent)
    rows = rows.join(components(led).hint("merge"), F.col("id") == F.col("node"), "left").withColumn("class", F.coalesce("component", "id")).drop("node", "component")
    rows = materialize(rows, "members")
    several = rows.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("key")
    rows = materialize(rows.join(several.hint("merge"), "key", "left_semi"), "apart")
    pairs = met(rows, threshold, F.col("a.class") != F.col("b.class"))
    return components(led.union(confirmed(pairs, needed, threshold, percent)))


def _code(line: str) -> list[Column]:
    return [F.xxhash64(line).alias("id"), F.xxhash64(F.lit("line"), F.col(line)).alias("id2")]


def repeated(docs: DataFrame, threshold: int = THRESHOLD, percent: int = PERCENT, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, hash, drops``: the line numbers of each document that an earlier line of their class makes redundant."""
    places = occurrences(docs, min_chars)
    lines = places.groupBy("line").agg(F.count("*").alias("times")).select("line", *_code("line"), "times", F.char_length("line").alias("n"))
    lines = materialize(measured(lines, threshold), "lines")
    # a line too short for one edit is near to none but itself
    compared = lines.where(worded(F.col("line"), min_words) & (F.col("n") * percent >= 100))
    labels = classes(compared, threshold, percent)
    found = lines.join(labels.hint("merge"), F.col("id") == F.col("node"), "left").where("times > 1 or component is not null")
    found = materialize(found.select("id", "id2", F.coalesce("component", "id").alias("class")), "repeated")
    rows = places.select(F.struct("doc_id", "hash", "pos").alias("place"), *_code("line")).join(found.hint("merge"), ["id", "id2"])
    rows = materialize(rows.select("class", "place"), "places")
    firsts = rows.groupBy("class").agg(F.min("place").alias("first"))
    rows = rows.join(firsts.hint("merge"), "class").where("place <> first")
    return rows.groupBy("place.doc_id", "place.hash").agg(F.array_sort(F.collect_set("place.pos")).alias("drops"))


def drop_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` less its dropped lines, and ``drops``, their numbers (null: none)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), whole.alias("text"))
    docs = docs.drop("drops")
    drops = materialize(repeated(plain, threshold, percent, min_words, min_chars), "drops").toDF("__line_doc", "__line_hash", "drops")
    rows = docs.withColumn("__line_own", F.xxhash64(whole))
    rows = rows.join(drops.hint("merge"), F.col(key).cast("long").eqNullSafe(F.col("__line_doc")) & (F.col("__line_own") == F.col("__line_hash")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("drops", i)), "\n")
    kept = F.when(kept.rlike(r"\S"), kept).otherwise("")
    return rows.withColumn(text, F.when(F.col("drops").isNull(), F.col(text)).otherwise(kept)).drop("__line_doc", "__line_hash", "__line_own")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    out = drop_repeated_lines(docs)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), F.char_length(text).cast("long").alias("kept_chars"), F.md5(text.cast("binary")).alias("kept_md5"))


#: The same classes in DuckDB: all pairs of lines of nearly equal length and letter counts. ``levenshtein`` counts bytes there, so the
#: characters beyond ASCII that occur (30 at most) stand as control characters.
OP5_SQL = r"""
with recursive d as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select doc_id, unnest(l) as raw, generate_subscripts(l, 1) - 1 as pos from d),
o as (select doc_id, pos, {'d': doc_id, 'p': pos} as place, trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) as line from x),
f as (select line, min(place) as id, length(line) as n from o where length(line) >= 20 group by line),
u as (select c, row_number() over (order by c) as k from (select distinct unnest(string_split(line, '')) as c from f) where c > '~'),
m as (select string_agg(c, '' order by k) as c, string_agg(chr((k + case when k > 9 then 1 else 0 end)::int), '' order by k) as t from u),
h as (select f.*, case when m.c is null then line else translate(line, m.c, m.t) end as s, list_transform(['e', 't', 'a', 'o', 'n', 'i', 's', 'h', 'r', 'd', ' ', 'u', 'l', 'c'], lambda c: n - length(replace(line, c, ''))) as v from f, m where regexp_matches(line, '^(\S+\s+){4}\S')),
p as (select a.id as a, b.id as b, a.s, b.s as t, a.n from h a join h b on b.n between a.n and a.n + 3 and (a.n < b.n or a.id < b.id) and abs(a.v[1] - b.v[1]) < 4 and abs(a.v[2] - b.v[2]) < 4 and abs(a.v[3] - b.v[3]) < 4 and abs(a.v[4] - b.v[4]) < 4 and abs(a.v[5] - b.v[5]) < 4 and abs(a.v[6] - b.v[6]) < 4 and abs(a.v[7] - b.v[7]) < 4 and abs(a.v[8] - b.v[8]) < 4 and abs(a.v[9] - b.v[9]) < 4 and abs(a.v[10] - b.v[10]) < 4 and abs(a.v[11] - b.v[11]) < 4 and abs(a.v[12] - b.v[12]) < 4 and abs(a.v[13] - b.v[13]) < 4 and abs(a.v[14] - b.v[14]) < 4),
e as (select a, b from p where levenshtein(s, t) <= least(3, n * 10 // 100)),
g as (select a, b from e union select b, a from e),
r(node, other) as (select id, id from f union select r.node, g.b from r join g on g.a = r.other),
c as (select node, min(other) as first from r group by node),
k as (select o.doc_id, list(o.pos) as drops from o join f using (line) join c on c.node = f.id where o.place <> c.first group by o.doc_id),
z as (select d.doc_id, len(l) as n_lines, coalesce(len(drops), 0) as n_dropped, text, array_to_string(list_filter(l, lambda v, i: not list_contains(drops, i - 1)), chr(10)) as kept, drops from d left join k using (doc_id)),
q as (select *, case when drops is null then text when regexp_matches(kept, '\S') then kept else '' end as final from z)
select doc_id, n_lines::bigint as n_lines, n_dropped::bigint as n_dropped, length(final)::bigint as kept_chars, md5(final) as kept_md5 from q
"""
