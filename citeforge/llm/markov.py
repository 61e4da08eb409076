"""Secret scans: patterns, and character Markov models of random strings and of identifiers.

All on DataFrame functions. Two first-order models over the characters of tokens, one of random
strings and one of ordinary identifiers, are trained from labelled samples. A token of ``LEAST``
characters or more is a secret where the random model is more likely by ``MARGIN`` nats a character,
and so is every part of ``LEAST`` characters or more of a token for which that holds. Spans of the
patterns stay as they are; the models add spans that overlap none of these.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.llm import shared

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the base kinds; the second group of the first one is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
LEAST = 20
MARGIN = 1.75

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET)

#: Bounds of the labelled sample: documents (those first by their id's hash) and random strings.
SAMPLE_DOCS = 400
RANDOM_STRINGS = 3000

_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
_NONE = f"cast(array() as {_SPAN})"


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(text, random): hash digests in several alphabets; words of documents, and pairs of words
    joined as in code and paths; numbers alone and after words; runs of one character, which are not
    random either."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    strings = spark.range(RANDOM_STRINGS).select(F.explode(F.array(base64, F.regexp_replace(base64, "[+/]", "x"), F.translate(base64, "+/", "-_"), F.upper(F.translate(base64, "+/", "07")), digest)).alias("text"))
    usable = docs.where("text is not null and doc_id is not null")
    ids = shared.sample_ids(usable, SAMPLE_DOCS)
    words = usable.where(F.col("doc_id").isin(ids)).select(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w"))
    n = F.size("w")
    after = F.slice("w", 2, F.greatest(n, F.lit(1)))

    def paired(mark: str) -> Column:
        return F.zip_with("w", after, lambda a, b: F.concat(a, F.lit(mark), F.coalesce(b, F.lit(""))))

    joined = [paired(mark) for mark in ("", "_", "-", "/", "2", "=")]
    camel = F.zip_with("w", after, lambda a, b: F.concat(a, F.initcap(F.coalesce(b, F.lit("")))))
    ordinary = words.select(F.explode(F.concat("w", camel, *joined, F.transform("w", F.upper))).alias("text"))
    runs = spark.range(SIZE).select(F.repeat(F.substring(F.lit(ALPHABET), (F.col("id") + 1).cast("int"), F.lit(1)), F.lit(200)).alias("text"))
    number = lambda k: F.substring(F.conv(F.substring(digest, k, 14), 16, 10), 1, 4 + k % 13)
    numbers = spark.range(RANDOM_STRINGS).select(F.explode(F.array(*[F.concat_ws(m, F.lit("id"), number(1), number(17), number(33)) for m in "/_-="])).alias("text"))
    return strings.select("text", F.lit(True).alias("random")).union(ordinary.union(numbers).union(runs).select("text", F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs, row by row, from (text, random) samples.

    Pairs are counted in Spark; at most 2 x 67 x 67 counts reach the driver. Pairs that a model has
    not seen have the probability of half an occurrence. A character's repeat or successor never
    speaks for the random model, as in runs and listed alphabets. Without samples all ratios are 0.
    """
    chars = F.split(F.col("text"), "")
    pairs = samples.where(F.length("text") > 1).select("random", F.explode(F.zip_with(chars, F.slice(chars, 2, F.greatest(F.length("text"), F.lit(1))), lambda a, b: F.concat(a, b))).alias("pair"))
    counted = pairs.where(F.length("pair") == 2).where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").count().collect()
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = {kind: [[0.5] * SIZE for _ in range(SIZE)] for kind in (True, False)}
    for kind, pair, n in counted:
        counts[kind][place[pair[0]]][place[pair[1]]] += n
    out = []
    for i in range(SIZE):
        random, ordinary = counts[True][i], counts[False][i]
        a, b = sum(random), sum(ordinary)
        row = [math.log(random[j] / a) - math.log(ordinary[j] / b) for j in range(SIZE)]
        out += [min(x, 0.0) if j in (i, i + 1) else x for j, x in enumerate(row)]
    return out


def _array(values, kind: str) -> Column:
    """A literal array, as one expression that the optimizer folds."""
    return F.expr(f"cast(split('{','.join(f'{v:.5g}' for v in values)}', ',') as array<{kind}>)")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def ratio_steps(token: Column, ratios: list[float]) -> Column:
    """Nats by which the random model is the likelier one, for each pair of a token's characters."""
    place = [ALPHABET.find(chr(c)) for c in range(128)]
    codes = F.transform(F.split(token, ""), lambda c: F.get(_array(place, "int"), F.ascii(c)))
    pair = lambda a, b: F.get(_array(ratios, "double"), a * SIZE + b)
    return _let(codes, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.coalesce(pair(a, b), F.lit(0.0))))


#: Less than any sum of steps; a step of a base span's character.
_NEVER, _TAKEN = -1e15, -1e6


def best_parts(steps: Column) -> Column:
    """(a, e): places in a token of its best disjoint parts of ``LEAST`` characters or more whose
    steps sum to 0 or more; e is past the end. One pass: a sum over the last ``LEAST`` - 1 steps
    starts a part, the greatest sum that ends at each step lengthens it, and a second one, of parts
    behind the best one so far, closes that one.
    """
    width = LEAST - 1
    older = F.concat(F.array_repeat(F.lit(0.0), width), steps)
    zero = F.expr(f"named_struct('i', 0, 'w', 0.0D, 'b', {_NEVER}D, 'a', 0, 'c', {_NEVER}D, 'ca', 0, 'peak', -1.0D, 'pa', 0, 'pe', -2, 'out', cast(array() as array<struct<a:int,e:int>>))")

    def closed(z: Column) -> Column:
        return F.concat(z["out"], F.array(F.struct(z["pa"].alias("a"), (z["pe"] + 2).alias("e"))))

    def step(z: Column, x: Column) -> Column:
        w, first = z["w"] + x["d"] - x["o"], z["i"] - (width - 1)
        fresh = F.when(first >= 0, w).otherwise(_NEVER)
        behind = F.when((first >= 0) & (first >= z["pe"] + 2), w).otherwise(_NEVER)
        b, c = z["b"] + x["d"], z["c"] + x["d"]
        grown = F.struct(
            w.alias("w"),
            F.greatest(b, fresh).alias("b"),
            F.when(fresh > b, first).otherwise(z["a"]).alias("a"),
            F.greatest(c, behind).alias("c"),
            F.when(behind > c, first).otherwise(z["ca"]).alias("ca"),
        )

        def decide(n: Column) -> Column:
            known = z["peak"] >= 0
            up = (n["b"] >= 0) & (n["b"] > z["peak"])
            split = ~up & known & (n["c"] >= 0)
            pick = lambda x, y, z: F.when(up, x).when(split, y).otherwise(z)
            done = split | (up & known & (n["a"] >= z["pe"] + 2))
            return F.struct(
                (z["i"] + 1).alias("i"),
                n["w"].alias("w"),
                F.when(split, n["c"]).otherwise(n["b"]).alias("b"),
                F.when(split, n["ca"]).otherwise(n["a"]).alias("a"),
                F.when(up | split, F.lit(_NEVER)).otherwise(n["c"]).alias("c"),
                n["ca"].alias("ca"),
                pick(n["b"], n["c"], z["peak"]).alias("peak"),
                pick(n["a"], n["ca"], z["pa"]).alias("pa"),
                pick(z["i"], z["i"], z["pe"]).alias("pe"),
                F.when(done, closed(z)).otherwise(z["out"]).alias("out"),
            )

        return _let(grown, decide)

    pairs = F.zip_with(steps, F.slice(older, 1, F.size(steps)), lambda d, o: F.struct(d.alias("d"), o.alias("o")))
    return F.aggregate(pairs, zero, step, lambda z: F.when(z["peak"] >= 0, closed(z)).otherwise(z["out"]))


#: Matches of a text that are numbered at once; appending to an array copies it.
MATCHES = 256


def matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Leftmost matches as (start, kind, end, value) in code points, from the pieces between them.

    Places are summed in blocks of ``MATCHES``, then over the blocks, so that a very long text with
    very many matches takes time in proportion to them, but for one copy a block.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")
    parts = [F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("p"), found]
    parts.append((F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found).alias("g"))
    zero = F.expr(f"named_struct('pos', 0L, 'out', {_NONE})")

    def step(a: Column, x: Column) -> Column:
        start = a["pos"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"), x["g"].alias("value"))
        return F.struct(end.cast("long").alias("pos"), F.concat(a["out"], F.array(span)).alias("out"))

    def shifted(s: Column, by: Column) -> Column:
        return F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value"))

    def join(a: Column, block: Column) -> Column:
        more = F.transform(block["out"], lambda s: shifted(s, a["pos"]))
        return F.struct((a["pos"] + block["pos"]).alias("pos"), F.concat(a["out"], more).alias("out"))

    def in_blocks(zipped: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(zipped), F.lit(1)), F.lit(MATCHES))
        blocks = F.transform(starts, lambda i: F.aggregate(F.slice(zipped, i, F.lit(MATCHES)), zero, step))
        return F.aggregate(blocks, zero, join, lambda a: a["out"])

    return F.when(text.rlike(pattern), _let(F.arrays_zip(*parts), in_blocks)).otherwise(F.expr(_NONE))


def base_spans(text: Column) -> Column:
    """The patterns' matches by start and kind; those that fail their rule are dropped."""
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= 6)
    access = F.filter(matches(text, ACCESS, 1), lambda s: F.length(s["value"]) >= 20)
    return F.array_sort(F.concat(assign, access, matches(text, HEX, 2)))


def first_place(spans: Column, above) -> Column:
    """The place, from 0, of the first span for which ``above`` holds, by bisection; the size if there is none.

    ``above`` must hold for all spans behind one for which it holds.
    """
    halvings = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int")))
    whole = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def halve(z: Column, _: Column) -> Column:
        mid = F.shiftright(z["lo"] + z["hi"], 1)
        hit = F.coalesce(above(F.get(spans, mid)), F.lit(True))
        return F.struct(F.when(hit, z["lo"]).otherwise(mid + 1).alias("lo"), F.when(hit, mid).otherwise(z["hi"]).alias("hi"))

    return F.aggregate(halvings, whole, lambda z, i: F.when(z["lo"] < z["hi"], halve(z, i)).otherwise(z), lambda z: z["lo"])


def taken_from(spans: Column, a: Column, e: Column) -> Column:
    """The spans of the places from a to before e; a slice would copy them all."""
    some = lambda x: F.when(x["a"] < x["e"], F.transform(F.sequence(x["a"], x["e"] - 1), lambda i: F.get(spans, i))).otherwise(F.expr(_NONE))
    return _let(F.struct(a.alias("a"), e.alias("e")), some)


def overlapping(kinds: list[Column], start: Column, end: Column) -> Column:
    """The spans that overlap a range. Spans of one kind are disjoint and in order, so each kind's are a slice."""
    found = []
    for spans in kinds:
        a, e = first_place(spans, lambda b: b["end"] > start), first_place(spans, lambda b: b["start"] >= end)
        found.append(taken_from(spans, a, e))
    return F.concat(*found)


def random_spans(s: Column, near: Column, ratios: list[float]) -> Column:
    """The random parts of a token ``s`` that overlap none of ``near``, the base spans that touch it.

    A token that is random as a whole is one span. In others, and beside base spans, each part of
    ``best_parts`` is one, together with the letters and digits that it touches.
    """
    v, size = s["value"], F.length(s["value"])

    def judged(steps: Column) -> Column:
        apart = F.size(near) == 0
        whole = apart & (F.aggregate(steps, F.lit(0.0), lambda z, x: z + x) >= 0)
        taken = F.transform(steps, lambda x, i: F.when(F.exists(near, lambda b: (b["start"] <= s["start"] + i + 1) & (s["start"] + i < b["end"])), F.lit(_TAKEN)).otherwise(x))
        parts = best_parts(F.when(apart, steps).otherwise(taken))
        return F.when(whole, F.array(s)).otherwise(_let(parts, lambda p: merged(F.transform(p, lambda x, k: widened(s, v, size, near, p, x, k)), s)))

    def widened(s: Column, v: Column, size: Column, near: Column, parts: Column, x: Column, k: Column) -> Column:
        """The part with the letters and digits before and after it, up to its neighbours."""
        before = F.transform(F.filter(near, lambda b: b["end"] <= s["start"] + x["a"]), lambda b: (b["end"] - s["start"]).cast("int"))
        after = F.transform(F.filter(near, lambda b: b["start"] >= s["start"] + x["e"]), lambda b: (b["start"] - s["start"]).cast("int"))
        low = F.greatest(F.lit(0), F.array_max(before), F.get(parts, k - 1)["e"])
        high = F.least(size, F.array_min(after), F.get(parts, k + 1)["a"])
        run = lambda piece: F.length(F.regexp_extract(piece, "^[A-Za-z0-9]*", 0))
        a = x["a"] - run(F.reverse(v.substr(low + 1, x["a"] - low)))
        e = x["e"] + run(v.substr(x["e"] + 1, high - x["e"]))
        return F.struct(a.alias("a"), e.alias("e"))

    def merged(parts: Column, s: Column) -> Column:
        """Spans of the parts; those that touch are one."""
        none = F.expr("cast(array() as array<struct<a:int,e:int>>)")

        def add(z: Column, x: Column) -> Column:
            last = F.element_at(z, -1)
            joined = F.concat(F.slice(z, 1, F.size(z) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["e"], x["e"]).alias("e"))))
            return F.when(F.size(z) == 0, F.array(x)).when(last["e"] >= x["a"], joined).otherwise(F.concat(z, F.array(x)))

        def span(x: Column) -> Column:
            value = s["value"].substr(x["a"] + 1, x["e"] - x["a"])
            return F.struct((s["start"] + x["a"]).alias("start"), s["kind"].alias("kind"), (s["start"] + x["e"]).alias("end"), value.alias("value"))

        return F.transform(F.aggregate(parts, none, add), span)

    return _let(F.transform(ratio_steps(v, ratios), lambda x: x - MARGIN), judged)


def find_secrets(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """``docs`` with base_spans and all_spans, arrays of (start, kind, end, value) by start and kind.

    A null text is empty, and an empty one has no spans. Rows keep their number and their other
    columns, null ids and repeated rows included; columns of these two names that are there already
    are replaced. A very long text is searched whole, in its row; base spans are found for each token
    by bisection, so its time follows tokens and spans together. Only inside one very long token with
    very many of them does it follow their product. An empty table gives an empty one. No shuffle.
    """
    ratios = train(labelled_samples(docs)) if ratios is None else ratios
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("base_spans", base_spans(text))
    # Columns of their own keep the expressions flat; Spark's analysis of nested functions grows with their depth.
    of_kind = lambda k: F.filter("base_spans", lambda b: b["kind"] == k).alias(f"k{k}")
    found = found.withColumns({"__secret_tokens": matches(text, TOKEN, 3), "__secret_kinds": F.struct(*[of_kind(k) for k in range(3)])})
    kinds = [F.col(f"__secret_kinds.k{k}") for k in range(3)]
    near = F.when(F.size("base_spans") == 0, F.transform("__secret_tokens", lambda s: F.expr(_NONE))).otherwise(F.transform("__secret_tokens", lambda s: overlapping(kinds, s["start"], s["end"])))
    found = found.withColumn("__secret_near", near)
    added = F.flatten(F.zip_with("__secret_tokens", "__secret_near", lambda s, n: random_spans(s, n, ratios)))
    return found.withColumn("all_spans", F.array_sort(F.concat("base_spans", added))).drop("__secret_tokens", "__secret_kinds", "__secret_near")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark; null stays null."""
    zero = F.expr("named_struct('pos', 0L, 'out', cast(array() as array<string>))")

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["pos"]
        kept = F.when(fresh, F.array(text.substr((a["pos"] + 1).cast("int"), (s["start"] - a["pos"]).cast("int")), F.lit(mark))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), F.concat(a["out"], kept).alias("out"))

    def finish(a: Column) -> Column:
        return F.concat(F.array_join(a["out"], ""), text.substr((a["pos"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, zero, step, finish)).otherwise(text)


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    added = (F.size("all_spans") - F.size("base_spans")).cast("long")
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"), added.alias("n_random"))
