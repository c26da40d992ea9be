"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

For edit threshold t a line is split into t + 1 segments, of which t edits leave one whole. Each distinct
line is indexed by its segments and probes the segments of lines up to t characters shorter, at the places
that segment could have moved to; candidates are verified by a banded bit-parallel edit distance. Lines in a
crowded segment are dealt again by all but t of many short pieces, and what is still crowded by the
pieces' remains after t characters are taken out or masked, so no group is paired whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, read, table, unused

EDITS, NEAR_CHARS = 2, 20
#: Members of a key up to which they are compared; characters that are counted to tell two lines apart before their distance.
CROWD, COUNTED = 512, "etaonirshdlu"
#: Pieces of a line in a crowded segment: so many at least, and none longer than PIECE characters.
FINER, PIECE = 16, 32
BLOCK = 16


def segment_bounds(size: Column, i, parts) -> tuple[Column, Column]:
    """First character (from 0) and length of segment ``i`` of ``parts`` of a line of ``size`` characters."""
    lo, hi = F.floor(i * size / parts).cast("int"), F.floor((i + 1) * size / parts).cast("int")
    return lo, hi - lo


def placements(edits: int) -> list[tuple[int, int, int]]:
    """(segment, how much shorter the indexed line is, how far the segment has moved): the segments before it hold at most so many
    edits as they are, and so do those after it. The first of each segment, (i, 0, 0), is the line's own."""
    return [(i, d, s) for i in range(edits + 1) for d in range(edits + 1) for s in sorted(range(-i, i + 1), key=abs) if abs(d - s) <= edits - i]


def segment_keys(line: Column, n: Column, edits: int) -> list[Column]:
    """For each of the :func:`placements` the key of a line of ``n`` characters: segment, length of the indexed line, and text."""
    made = []
    for i, shorter, moved in placements(edits):
        lo, size = segment_bounds(n - shorter, i, edits + 1)
        made.append(F.xxhash64(F.lit(i), n - shorter, F.substring(line, lo + (moved + 1), size)))
    return made


def piece_keys(line: Column, n: Column, edits: int) -> Column:
    """Finer keys of a line: struct(key, kind, open), the key of all but ``edits`` of its pieces, and the texts of those left open.

    Kind 0 are its own pieces; kind 1 those of a line of its length or up to ``edits`` shorter, every run of closed pieces moved by
    what the open pieces before it may have gained or lost.
    """

    def keys(shorter: int, moves: list[int]) -> Column:
        size = n - shorter
        parts = F.greatest(F.lit(FINER), F.ceil(size / PIECE).cast("int"))

        def start(p: Column) -> Column:
            return F.floor(p * size / parts).cast("int")

        def closed(s: Column, upto: Column) -> Column:
            at = start(s["p"])
            return F.xxhash64(s["key"], upto, F.substring(line, at + s["shift"] + 1, start(upto) - at))

        def opening(left: int):
            def after(s: Column) -> Column:
                def at(q: Column) -> Column:
                    made, width = [], start(q + 1) - start(q)
                    for d in moves:
                        text = F.substring(line, start(q) + s["shift"] + 1, width + d)
                        used = F.when(width + d >= 0, s["used"] + abs(d)).otherwise(edits + 1)
                        made.append(F.struct((q + 1).alias("p"), (s["shift"] + d).alias("shift"), used.alias("used"), closed(s, q).alias("key"), F.concat(s["open"], F.array(text)).alias("open")))
                    return F.array(*made)

                return F.filter(F.flatten(F.transform(F.sequence(s["p"], parts - 1 - left), at)), lambda x: x["used"] <= edits)

            return after

        states = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("shift"), F.lit(0).alias("used"), F.xxhash64(F.lit("pieces"), size).alias("key"), F.array().cast("array<string>").alias("open")))
        for left in range(edits - 1, -1, -1):
            states = F.flatten(F.transform(states, opening(left)))
        own = len(moves) == 1
        whole = F.filter(states, lambda s: (s["shift"] == shorter) & ((s["used"] > 0) | F.lit(own or shorter > 0)))
        return F.transform(whole, lambda s: F.struct(closed(s, parts).alias("key"), F.lit(0 if own else 1).alias("kind"), s["open"].alias("open")))

    return F.concat(keys(0, [0]), *[keys(d, list(range(-edits, edits + 1))) for d in range(edits + 1)])


def worn(text: Column, most: int) -> list[Column]:
    """For 0 to ``most`` changes the texts that ``text`` becomes: struct(s, at, out), each change a character out (counted in ``out``) or a mask over it, from left to right."""

    def step(w: Column) -> Column:
        size = F.length(w["s"])

        def change(j: Column) -> Column:
            before, after = F.substring(w["s"], F.lit(1), j - 1), F.substring(w["s"], j + 1, size)
            return F.array(F.struct(F.concat(before, after).alias("s"), j.alias("at"), (w["out"] + 1).alias("out")), F.struct(F.concat(before, F.lit("\n"), after).alias("s"), (j + 1).alias("at"), w["out"].alias("out")))

        return F.flatten(F.transform(F.filter(F.sequence(F.least(w["at"], size + 1), size + 1), lambda j: j <= size), change))

    found = [F.array(F.struct(text.alias("s"), F.lit(1).alias("at"), F.lit(0).alias("out")))]
    for _ in range(most):
        found.append(F.flatten(F.transform(found[-1], step)))
    return found


def worn_keys(key: Column, open_: Column, edits: int) -> Column:
    """struct(key, masks, out) for every way to take out or mask up to ``edits`` characters of the open pieces. Two lines of one piece key are
    within ``edits`` if, and only if, they share a worn key of equal masks for which masks + out of both <= edits. No line holds a line break, the mask."""

    def with_part(texts: list[Column]):
        def more(w: Column) -> Column:
            def of(k: int):
                return lambda t: F.struct(F.xxhash64(w["key"], t["s"]).alias("key"), (w["masks"] + k - t["out"]).alias("masks"), (w["out"] + t["out"]).alias("out"))

            return F.filter(F.concat(*[F.transform(own, of(k)) for k, own in enumerate(texts)]), lambda x: x["masks"] + x["out"] <= edits)

        return more

    ways = F.array(F.struct(F.xxhash64(key).alias("key"), F.lit(0).alias("masks"), F.lit(0).alias("out")))
    for part in range(edits):
        ways = F.flatten(F.transform(ways, with_part(worn(F.get(open_, F.lit(part)), edits))))
    return F.array_distinct(ways)


def banded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two strings, or ``most`` + 1 if it is larger: bit vectors of the vertical differences
    in a band of 2 * most + 1 diagonals slide down with the shorter string's characters. Both strings
    get the same ending, which leaves the distance as it is and makes them as long as the band is deep."""
    width = 2 * most + 1
    full = (1 << width) - 1
    long_, short = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)

    def inverse(x: Column) -> Column:
        return F.lit(full).bitwiseXOR(x)

    def run(s: Column) -> Column:
        up, down, n, m = s["up"], s["down"], s["n"], s["m"]

        def step(state: Column, i: Column) -> Column:
            char = F.get(down, i)
            match = sum((F.when(F.get(up, i + (most - width + 1 + k)).eqNullSafe(char), 1 << k).otherwise(0) for k in range(1, width)), F.when(F.get(up, i + (most - width + 1)).eqNullSafe(char), 1).otherwise(0))
            vp, vn = state["vp"], state["vn"]

            def after(x: Column) -> Column:
                d0 = (x.bitwiseAND(vp) + vp).bitwiseAND(F.lit(full)).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn)

                def rest(d: Column) -> Column:
                    hp, hn, d1 = vn.bitwiseOR(inverse(d.bitwiseOR(vp))), d.bitwiseAND(vp), F.shiftright(d, 1)
                    at = i - (n - most)  # columns past the band's foot; then the last row is followed
                    mask = F.when(at >= 0, F.call_function("shiftright", F.lit(1 << (width - 2)), at)).otherwise(0)
                    along = F.when(hp.bitwiseAND(mask) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(mask) != 0, 1).otherwise(0)
                    diagonal = F.when(d.bitwiseAND(F.lit(1 << (width - 1))) != 0, 0).otherwise(1)
                    return F.struct(hn.bitwiseOR(inverse(d1.bitwiseOR(hp))).alias("vp"), d1.bitwiseAND(hp).alias("vn"), (state["d"] + F.when(at < 0, diagonal).otherwise(along)).alias("d"))

                return bound(d0, rest)

            # along the band's foot the distance only grows, and in the last columns, ``most`` of them, it falls by one at most
            return F.when(state["d"] > 2 * most, state).otherwise(bound(match, after))

        start = F.struct(F.lit(full ^ ((1 << (width - most - 1)) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(most).alias("d"))
        found = F.aggregate(F.sequence(F.lit(0), m - 1), start, step, lambda z: z["d"])
        return F.when((n - m > most), most + 1).otherwise(F.least(found, F.lit(most + 1)))

    def chars(s: Column) -> Column:
        return F.concat(F.filter(F.split(s, ""), lambda c: c != ""), F.array_repeat(F.lit(""), most))

    parts = F.struct(chars(long_).alias("up"), chars(short).alias("down"), (F.length(long_) + most).alias("n"), (F.length(short) + most).alias("m"))
    return bound(parts, run)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(a: Column, b: Column) -> Column:
    """struct(a, b): both strings without the blocks they start and end with in common; the edit distance stays."""
    least = F.floor(F.least(F.length(a), F.length(b)) / BLOCK).cast("int")

    def leading(same) -> Column:
        differ = F.array_position(F.transform(F.sequence(F.lit(0), least), lambda k: F.when(k < least, same(k)).otherwise(False)), False)
        return (differ - 1).cast("int")

    head = leading(lambda k: F.substring(a, k * BLOCK + 1, F.lit(BLOCK)) == F.substring(b, k * BLOCK + 1, F.lit(BLOCK)))
    tail = leading(lambda k: F.substring(a, F.length(a) - (k + 1) * BLOCK + 1, F.lit(BLOCK)) == F.substring(b, F.length(b) - (k + 1) * BLOCK + 1, F.lit(BLOCK)))

    def both(ends: Column) -> Column:
        before, after = ends["head"], F.least(ends["tail"], least - ends["head"])
        cut = lambda s: F.substring(s, before * BLOCK + 1, F.length(s) - (before + after) * BLOCK)
        return F.struct(cut(a).alias("a"), cut(b).alias("b"))

    return bound(F.struct(head.alias("head"), tail.alias("tail")), both)


def near_distance(a: Column, b: Column, most: int) -> Column:
    return bound(trimmed(a, b), lambda t: banded_distance(t["a"], t["b"], most))


def document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, pos, line, h1, h2) of every line; two hashes name a line's text, ``t`` names the whole text, so that rows of one doc_id stay apart."""
    rows = columns_of(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def _met(rows: DataFrame, name: str) -> DataFrame:
    """Key rows whose key another row has too, one of them of kind 0, with the key's row count ``n``; a frequent key is counted before rows are shuffled."""
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("kind").alias("least")).where("n > 1 and least = 0").select("key", "n")
    return table(rows.join(table(keys, f"{name}-keys").hint("merge"), "key"), name)


def letters_of(line: Column) -> Column:
    """How often a line has each of the ``COUNTED`` characters, modulo 32, in five bits each."""
    parts = [F.shiftleft(F.pmod(F.length(line) - F.length(F.replace(line, F.lit(c))), F.lit(32)).cast("long"), 5 * i) for i, c in enumerate(COUNTED)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def letters_apart(a: Column, b: Column) -> Column:
    """Sum of the counts' differences, never more than the true one; an edit changes two counts by one at most."""
    gaps = [(F.shiftright(a, 5 * i) - F.shiftright(b, 5 * i)).bitwiseAND(F.lit(31)) for i in range(len(COUNTED))]
    return reduce(lambda x, y: x + y, [F.least(g, 32 - g) for g in gaps])


def _candidates(members: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (key, kind, id, letters, n) that share a key of few members and have about the same letters."""
    few = members.where(F.col("n") <= CROWD).select("key", "kind", "id", "letters")
    a, b = few.alias("a"), few.where("kind = 0").alias("b")
    both = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & ((F.col("a.kind") == 1) | (F.col("a.id") < F.col("b.id")))
    pairs = a.join(b, both & (letters_apart(F.col("a.letters"), F.col("b.letters")) <= 2 * edits))
    return pairs.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))


def line_links(firsts: DataFrame, lines: DataFrame, near_chars: int, edits: int) -> DataFrame:
    """(h1, h2, other): for lines within ``edits`` of each other, the first place (doc_id, pos) of the other line.

    ``firsts`` (h1, h2, first, n, keys) has each distinct line once. Candidates are named by h1 alone: lines of one h1 are verified
    each. Texts are fetched from ``lines``, and their letters counted, for lines that share a key alone.
    """
    kinds = [0 if d == s == 0 else 1 for _, d, s in placements(edits)]
    near = firsts.where(F.col("n") >= near_chars)
    rows = near.select(F.col("h1").alias("id"), F.explode(F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.lit(k).alias("kind")) for i, k in enumerate(kinds)])).alias("s")).select("id", "s.key", "s.kind")
    members = _met(rows, "line-segments")
    wanted = table(near.join(members.select(F.col("id").alias("h1")), "h1", "left_semi").select("h1", "h2", "first.doc_id", "first.pos"), "line-wanted").hint("merge")
    places = [F.col(f"l.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("h1", "h2", "doc_id", "pos")]
    texts = lines.alias("l").join(wanted.alias("w"), places[0] & places[1] & places[2] & places[3], "left_semi")
    texts = table(texts.select("h1", "h2", F.struct("doc_id", "pos").alias("first"), "line", letters_of(F.col("line")).alias("letters")), "line-texts")
    lettered = members.join(texts.select(F.col("h1").alias("id"), "letters"), "id")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda x: texts.select(F.col("h1").alias(x), F.col("h2").alias(f"{x}2"), F.col("first").alias(f"f{x}"), F.col("line").alias(f"l{x}"))
        both = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where((F.abs(F.length("la") - F.length("lb")) <= edits) & (F.col("la") != F.col("lb")))
        both = both.where(near_distance(F.col("la"), F.col("lb"), edits) <= edits)
        return both.select(F.explode(F.array(F.struct(F.col("a").alias("h1"), F.col("a2").alias("h2"), F.col("fb").alias("other")), F.struct(F.col("b").alias("h1"), F.col("b2").alias("h2"), F.col("fa").alias("other")))).alias("x")).select("x.*")

    crowd = members.where(F.col("n") > CROWD)
    if not crowd.limit(1).count():
        return verified(_candidates(lettered, edits))
    hot = texts.join(crowd.select(F.col("id").alias("h1")), "h1", "left_semi")
    finer = hot.select(F.col("h1").alias("id"), "h2", "first", "letters", F.explode(piece_keys(F.col("line"), F.length("line"), edits)).alias("s")).select("id", "h2", "first", "letters", "s.*")
    finer = _met(finer, "line-finer")
    out = verified(_candidates(lettered, edits).union(_candidates(finer, edits)))

    # still crowded: lines that meet under a worn key are near without being paired; each needs only the first place of the others
    left = finer.where(F.col("n") > CROWD).select(F.col("id").alias("h1"), "h2", "first", F.explode(worn_keys(F.col("key"), F.col("open"), edits)).alias("w"))
    left = left.select("h1", "h2", "first", F.xxhash64("w.key", "w.masks").alias("key"), "w.masks", "w.out")
    least = left.groupBy("key").agg(F.count("*").alias("n"), *[F.min(F.when(F.col("out") == k, F.col("first"))).alias(f"m{k}") for k in range(edits + 1)]).where("n > 1")
    seen = left.join(table(least, "line-worn"), "key")
    firsts_met = [F.when(F.col("out") + F.col("masks") + k <= edits, F.col(f"m{k}")) for k in range(edits + 1)]
    worn_out = seen.select("h1", "h2", F.least(*firsts_met).alias("other")).where("other is not null")
    return out.union(worn_out)


def line_verdicts(docs: DataFrame, near_chars: int = NEAR_CHARS, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, removed) of the texts (``t``: their hash) that lose lines; see :func:`line_decisions`."""
    lines = document_lines(docs, id_col, text_col)
    some = lines.where(F.trim("line") != "")
    n = F.length("line")
    keys = [F.when(n >= near_chars, k).alias(f"k{i}") for i, k in enumerate(segment_keys(F.col("line"), n, edits))]
    rows = some.select("h1", "h2", F.struct("doc_id", "pos").alias("at"), n.alias("n"), *keys)
    firsts = rows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("times"), F.max("n").alias("n"), *[F.max(f"k{i}").alias(f"k{i}") for i in range(len(keys))])
    firsts = table(firsts, "line-firsts")
    links = line_links(firsts, some.where(n >= near_chars), near_chars, edits).groupBy("h1", "h2").agg(F.min("other").alias("other"))
    near = F.coalesce(F.col("other") < F.col("first"), F.lit(False))
    judged = table(firsts.join(links, ["h1", "h2"], "left").where((F.col("times") > 1) | near).select("h1", "h2", "first", near.alias("near")), "line-judged")
    gone = some.select("doc_id", "t", "pos", "h1", "h2").join(judged, ["h1", "h2"]).where(F.col("near") | ~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def line_decisions(docs: DataFrame, near_chars: int = NEAR_CHARS, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, removed) of every document with text; removed: line numbers from 0, ascending.

    A line goes if an equal line, or (both from ``near_chars`` characters on) one within ``edits`` single edits, starts
    earlier: in a smaller doc_id (null before all), or before it in the same document. Blank lines stay. Links are judged on
    the input, so a line may go for one that goes too. Null text has no line and no row here; an empty text is one
    blank line. Rows that share a doc_id are told apart by their texts; the same line at the same number in both stands at one
    place, neither earlier. A line of any length is whole in one row; only lines in crowded segments cost more than their length.
    """
    removed = line_verdicts(docs, near_chars, edits, id_col, text_col)
    text = F.col(f"`{text_col}`").cast("string")
    counts = columns_of(docs, id_col, text_col).where(text.isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"))
    joined = counts.alias("c").join(removed.alias("r"), F.col("c.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("c.t") == F.col("r.t")), "left")
    return joined.select("c.doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, near_chars: int = NEAR_CHARS, edits: int = EDITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of its text (see :func:`line_decisions`); rows and columns stay, whatever their names.

    A text whose lines all go becomes empty; null stays null.
    """
    name = unused(docs, "removed")
    text = F.col(f"`{text_col}`").cast("string")
    removed = line_verdicts(docs, near_chars, edits, id_col, text_col).select(F.struct("doc_id", "t", "removed").alias(name))
    joined = docs.join(removed, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(f"{name}.doc_id")) & (F.xxhash64(text) == F.col(f"{name}.t")), "left")
    gone, parts = F.col(f"{name}.removed"), F.split(text, "\n", -1)

    def left(lines: Column) -> Column:  # what lies between the removed lines, each stretch sliced once
        between = F.transform(gone, lambda g, i: F.slice(lines, F.when(i == 0, 1).otherwise(F.get(gone, i - 1) + 2), g - F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)))
        return F.concat(F.flatten(between), F.slice(lines, F.element_at(gone, -1) + 2, F.size(lines)))

    shown = F.when(F.col(name).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(F.get(F.transform(F.array(parts), left), F.lit(0)), "\n"))
    return joined.select(*[shown.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of the removed lines, comma-joined."""
    found = line_decisions(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


OP8_SQL = r"""
WITH occ AS (SELECT doc_id, p - 1 AS pos, w[p] AS line FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents WHERE text IS NOT NULL))),
filled AS (SELECT * FROM occ WHERE trim(line, ' ') <> ''),
firsts AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS f FROM filled GROUP BY line),
long AS (SELECT * FROM firsts WHERE n >= 20),
own AS (SELECT line, n, f, i, substr(line, i * n // 3 + 1, (i + 1) * n // 3 - i * n // 3) AS seg FROM (SELECT *, unnest([0, 1, 2]) AS i FROM long)),
probe AS (SELECT line, n, f, m, i, substr(line, i * m // 3 + 1 + s, (i + 1) * m // 3 - i * m // 3) AS seg FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS s FROM (SELECT *, unnest([0, 1, 2]) AS i FROM (SELECT *, unnest([n - 2, n - 1, n, n + 1, n + 2]) AS m FROM long))) WHERE i * m // 3 + s >= 0),
met AS (SELECT DISTINCT a.line, a.f, b.line AS other, b.f AS g FROM probe a JOIN own b ON a.m = b.n AND a.i = b.i AND a.seg = b.seg WHERE a.line <> b.line AND b.f < a.f),
linked AS (SELECT DISTINCT line FROM met WHERE levenshtein(line, other) <= 2),
gone AS (SELECT s.doc_id, s.pos FROM filled s JOIN firsts f USING (line) LEFT JOIN linked l USING (line) WHERE l.line IS NOT NULL OR f.f <> (s.doc_id, s.pos)),
listed AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed_lines FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, coalesce(g.n_removed, 0) AS n_removed, coalesce(g.removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN listed g USING (doc_id) WHERE d.text IS NOT NULL
"""
