"""Secret scans with DataFrame expressions only.

Three patterns give the base spans. Beyond them, every run of ``MIN_CHARS`` or more token characters is scored under two
first-order character Markov models, one of random strings and one of ordinary identifiers; it is a secret when the
log-likelihood ratio is at least ``MIN_RATIO`` in all and ``MIN_MEAN`` for each step. Of other runs, the segments of
``MIN_CHARS`` or more that reach both are secrets: a segment ends at its highest sum once that has fallen by
``MIN_RATIO`` or to nothing, so that several in one run are all found. Spans found so that overlap a base span are left
to it.

The models are trained from labelled samples (token, random); :func:`labelled_samples` makes a default set by rule, and
the ordinary side takes up the tokens of the whole corpus (:func:`corpus_tokens`), each side with half the weight. The
counts that reach the driver are bounded by the square of the alphabet.

Edge cases: null or empty text has no spans; rows are scanned one by one, so ties and repeated rows give equal spans; a
null id is kept as it is; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed values of the result format.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, ACCESS_CHARS = r"AKIA[A-Z0-9]+", 20
HEX, HEX_CHARS = r"[0-9a-f]{24,}", 24
KINDS = ("assign", "access", "hex", "markov")

MIN_CHARS = 16
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}"
MIN_RATIO, MIN_MEAN = 12.0, 0.6
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLES = 4000
_WORDS = (
    "user name get set value index list count total result data file path read write open close time date start stop "
    "error message config option default type class method string number order item price customer account address "
    "first last next previous parent child node tree graph table column row field record key query filter group sort "
    "limit offset page size width height color image button click event handler listener request response client server "
    "session cookie header body content format parse build create update delete insert select buffer stream thread "
    "process queue stack heap memory cache load save test check verify compute length strong language water house "
    "between because through another country picture thought different important nichtigkeit entscheidung verbindung "
    "gesellschaft geschichte zwischen wirtschaft einheit schule freiheit toujours maintenant quelque question entre "
    "gouvernement peuvent autre temps siempre entonces nosotros ciudad palabra hombre mujer trabajo corazon"
)


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(token, random): ``n`` random strings and ``n`` identifiers, made by rule and equal on every run."""
    ids = spark.range(n)
    digest = F.sha2(F.col("id").cast("string"), 256)
    raw = F.base64(F.unhex(digest))
    kind = F.col("id") % 4
    random = F.when(kind == 0, digest).when(kind == 1, F.upper(F.translate(raw, "+/=", ""))).otherwise(raw)
    words = F.split(F.lit(_WORDS), " ")
    pick = [F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)) + 1).cast("int")) for k in range(4)]
    style = F.col("id") % 9
    ordinary = (
        F.when(style == 0, F.concat_ws("_", *pick))
        .when(style == 1, F.upper(F.concat_ws("_", *pick)))
        .when(style == 2, F.concat(pick[0], *[F.initcap(p) for p in pick[1:]]))
        .when(style == 3, F.concat_ws("-", *pick))
        .when(style == 4, F.concat_ws("/", *pick))
        .when(style == 5, F.concat(pick[0], pick[1], F.lpad((F.col("id") * 37 % 10000).cast("string"), 4, "0"), F.lit("-20240131-"), (F.col("id") * 7919).cast("string")))
        .when(style == 6, F.upper(F.concat(*pick)))
        .when(style == 7, F.repeat(F.substr(F.lit(ALPHABET), F.pmod(F.xxhash64("id"), F.lit(len(ALPHABET))).cast("int") + 1, F.lit(1)), F.lit(24)))
        .otherwise(F.concat(*pick))
    )
    return ids.select(random.alias("token"), F.lit(True).alias("random")).unionByName(
        ids.select(ordinary.alias("token"), F.lit(False).alias("random"))
    )


def _steps_of(tokens: DataFrame) -> DataFrame:
    """(..., step, count): pairs of neighbouring characters of the tokens."""
    chars = F.split("token", "")
    steps = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: F.concat(a, b))
    others = [c for c in tokens.columns if c != "token"]
    found = tokens.where(F.length("token") > 1).select(*others, F.explode(steps).alias("step"))
    return found.where(F.col("step").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy(*others, "step").count()


def corpus_tokens(docs: DataFrame) -> DataFrame:
    """(token): every run of token characters that two or more different texts of the corpus have, once.

    Secrets are as good as always in one text, or in copies of it, and each counts once.
    """
    runs = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{2,}"), F.lit(0)))
    x = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), runs.alias("runs"))
    x = x.select("h", F.explode("runs").alias("token"))
    return x.groupBy("token").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("token")


def ratio_table(samples: DataFrame, corpus: DataFrame | None = None, smooth: float = 0.5) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary), row by row of the alphabet.

    With a corpus (token), its steps are as much of the ordinary side as those of the samples.
    """
    n = len(ALPHABET)
    seen = {True: [[smooth] * n for _ in range(n)], False: [[smooth] * n for _ in range(n)]}

    def add(rows: list, random: bool, weight: float) -> None:
        for step, count in rows:
            seen[random][ALPHABET.index(step[0])][ALPHABET.index(step[1])] += count * weight

    found = {k: [(r["step"], r["count"]) for r in _steps_of(samples).collect() if r["random"] == k] for k in (True, False)}
    for k, rows in found.items():
        add(rows, k, 1.0)
    if corpus is not None:
        own = [(r["step"], r["count"]) for r in _steps_of(corpus).collect()]
        total = sum(c for _, c in own)
        add(own, False, sum(c for _, c in found[False]) / total if total else 0.0)
    out = []
    for yes, no in zip(seen[True], seen[False], strict=True):
        a, b = sum(yes), sum(no)
        out += [math.log(x / a) - math.log(y / b) for x, y in zip(yes, no, strict=True)]
    return out


#: Steps of a run over an array after which what it found is put aside.
PART = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _gather(items: Column, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], kind: str) -> Column:
    """Run over an array with a state; ``step`` gives the next state and an array of results, which are gathered.

    An aggregate copies its state at every step, so results that it carried along would cost the square of their number.
    Steps are taken in parts, and parts in parts of parts, so that few results travel with any of them.
    """
    none = F.array().cast(f"array<{kind}>")

    def held(found: Column | dict[str, Column], out: Column) -> Column:
        own = found if isinstance(found, dict) else {n: found[n] for n in state}
        return F.struct(*[c.alias(n) for n, c in own.items()], out.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        following, found = step(acc, x)
        return held(following, F.concat(acc["out"], found))

    def run(part: Column, at: Column | dict[str, Column], depth: int) -> Column:
        if not depth:
            return F.aggregate(part, held(at, none), one)
        size = PART**depth
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.size(part) / size)).cast("int") - 1)

        def block(acc: Column, b: Column) -> Column:
            inner = _let(F.slice(part, b * size + 1, F.lit(size)), lambda p: run(p, acc, depth - 1))
            return _let(inner, lambda r: held(r, F.concat(acc["out"], F.array(r["out"]))))

        return F.aggregate(blocks, held(at, F.array().cast(f"array<array<{kind}>>")), block, lambda acc: held(acc, F.flatten(acc["out"])))

    return _let(items, lambda v: F.when(F.size(v) <= PART, run(v, state, 0)["out"]).otherwise(run(v, state, 2)["out"]))


SPAN = "struct<start:int,kind:int,stop:int,text:string>"


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all matches, as structs (start, kind, stop, text), found from the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(between, found, lambda b, m: F.struct(F.char_length(b).alias("gap"), m.alias("text")))

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        at = acc["at"] + x["gap"]
        stop = at + F.char_length(x["text"])
        one = F.struct(at.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["text"].alias("text"))
        return {"at": stop}, F.array(one)

    spans = _gather(F.filter(sizes, lambda x: x["text"].isNotNull()), {"at": F.lit(0)}, step, SPAN)
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _free(base: Column, found: Column) -> Column:
    """The found spans that overlap no base span: one pass along the starts, one back, whatever their number."""
    every = F.sort_array(F.concat(base, found))
    none = F.array().cast(f"array<{SPAN}>")
    markov = len(KINDS) - 1

    def along(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        covered = (x["kind"] == markov) & (acc["reach"] > x["start"])
        return {"reach": F.when(x["kind"] < markov, F.greatest(acc["reach"], x["stop"])).otherwise(acc["reach"])}, F.when(covered, none).otherwise(F.array(x))

    def back(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        clear = (x["kind"] == markov) & (acc["next"] >= x["stop"])
        return {"next": F.when(x["kind"] < markov, x["start"]).otherwise(acc["next"])}, F.when(clear, F.array(x)).otherwise(none)

    left = F.reverse(_gather(every, {"reach": F.lit(0)}, along, SPAN))
    return F.when(F.size(found) > 0, _gather(left, {"next": F.lit((1 << 31) - 1)}, back, SPAN)).otherwise(none)


def _steps(token: Column, ratios: Column) -> Column:
    """The log-likelihood ratios of the token's steps."""
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    n = len(ALPHABET)
    return F.zip_with(F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places) - 1), lambda a, b: F.get(ratios, a * n + b))


def _ratio(token: Column, ratios: Column) -> Column:
    """Sum of the log-likelihood ratios of the token's steps."""
    return F.aggregate(_steps(token, ratios), F.lit(0.0), lambda acc, x: acc + x)


def _segments(steps: Column) -> Column:
    """The random segments (first, last) of a token by its steps, characters counted from 0."""
    kind = "struct<first:int,last:int>"
    none = F.array().cast(f"array<{kind}>")
    zero, nought = F.lit(0.0), F.lit(0)

    def closed(acc: Column) -> Column:
        size = acc["last"] - acc["first"]
        good = (acc["top"] >= MIN_RATIO) & (acc["top"] >= MIN_MEAN * size) & (size + 1 >= MIN_CHARS)
        return F.when(good, F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last")))).otherwise(none)

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        at, total = acc["at"] + 1, acc["total"] + x
        over = (total <= 0) | (total <= acc["top"] - MIN_RATIO)
        higher = total > acc["top"]
        following = {
            "at": at, "total": F.when(over, zero).otherwise(total), "first": F.when(over, at).otherwise(acc["first"]),
            "top": F.when(over, zero).when(higher, total).otherwise(acc["top"]), "last": F.when(over | higher, at).otherwise(acc["last"]),
        }
        return following, F.when(over, closed(acc)).otherwise(none)

    # a last step that falls to nothing closes what is open
    ended = F.concat(steps, F.array(F.lit(-math.inf)))
    return _gather(ended, {"at": nought, "total": zero, "first": nought, "top": zero, "last": nought}, step, kind)


def find_secrets(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """(doc_id, base, spans): base spans, and all spans, as structs (start, kind, stop, text) in order."""
    scores = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    x = x.select("doc_id", *[_spans(F.col("_text"), p, k).alias(KINDS[k]) for k, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN))])
    assign = F.filter("assign", lambda s: F.char_length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 6)
    access = F.filter("access", lambda s: s["stop"] - s["start"] >= ACCESS_CHARS)
    hexes = F.filter("hex", lambda s: s["stop"] - s["start"] >= HEX_CHARS)
    x = x.select("doc_id", F.sort_array(F.concat(assign, access, hexes)).alias("base"), "markov")

    def random(s: Column) -> Column:
        steps = _steps(s["text"], scores)
        score = F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)
        whole = (score >= MIN_RATIO) & (score >= MIN_MEAN * F.size(steps))

        def part(x: Column) -> Column:
            size = x["last"] - x["first"] + 1
            start = s["start"] + x["first"]
            return F.struct(start.alias("start"), s["kind"].alias("kind"), (start + size).alias("stop"), F.substring(s["text"], x["first"] + 1, size).alias("text"))

        return F.when(whole, F.array(s)).otherwise(F.transform(_segments(steps), part))

    found = F.flatten(F.transform("markov", random))
    x = x.select("doc_id", "base", found.alias("found"))
    free = F.when(F.size("base") > 0, _free(F.col("base"), F.col("found"))).otherwise(F.col("found"))
    return x.select("doc_id", "base", F.sort_array(F.concat("base", free)).alias("spans"))


def listed(spans: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, ratio_table(labelled_samples(spark), corpus_tokens(docs)))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", *map(count, range(3)), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
