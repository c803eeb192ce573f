"""Personal data: regular spans, and a bootstrapped contextual extraction beyond them.

Base spans (emails, IP addresses, card and phone numbers) are found by pattern and
checked by rule. Beside them every mention that has a digit or an at sign (a word, or
digits in groups) is a possible instance of the kinds whose loose shape it has. What
stands around a mention and what it looks like are its lexical patterns: the word or
two words before, the word after, both sides, the name it is assigned to, and its
shape. Mentions that are base spans by themselves, and secrets of a public format, are
the seeds.

Spark scores the pattern-instance graph in rounds. A pattern's confidence in a kind is
the share of known instances among those that it extracts, instances that are known as
another kind counting in full against it, unknown ones in part, and those that fail the
kind's check digit as the ninth of them that would pass by chance. A candidate's score is one less the product of its patterns' doubts. Candidates
that score high become instances, of plain numbers only those that words or a check digit
support too, which lend their other patterns weight in the next round, until a round
finds none.

All of it is DataFrame functions. The graph is aggregated to (pattern, instance)
before the rounds, so a word that stands beside a third of all identifiers is one
row for each instance, and the rounds never see the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import checkpointed, small, table, text_of

KINDS = ("email", "ip", "card", "phone")

# Possessive and anchored forms of the base patterns: they match what the plain
# forms match, leftmost and without overlap, in time linear in the text. Emails may
# begin in mid-run only where the last match ended; card runs are matched only at
# their full length, shorter and longer ones being dropped anyway.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

# Groups of digits with blanks, brackets, dots and hyphens between; else a word.
MENTION = r"(?<![^\x20\x09-\x0D])(?:[(+]{0,2}[0-9]++(?:[\x20().-]{1,2}[0-9]++)++(?![\p{L}0-9@])|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
#: What a word assigns its value to, or opens it with: ``password=``, ``mailto:``, a quote.
HEAD = r"^[^0-9@=:]*+[=:][^\p{L}\p{N}+]*+|^[^\p{L}\p{N}+(]++"
MIXED = r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])"

#: Kinds beyond the base ones, which the bootstrap alone finds.
FOUND_KINDS = (*KINDS, "secret")
CARD = KINDS.index("card")
# Public formats of secrets, the seeds of that kind.
SECRET = MIXED + r"(?:[0-9a-f]{32,}|AKIA[0-9A-Z]{16})$"

MIN_CONFIDENCE = 0.6  # of a pattern
MIN_INSTANCES = 5  # distinct known ones, of a pattern
MIN_SCORE = 0.7  # of a candidate
LUCK = 1 / 9  # numbers that pass a check digit by chance, for each that fails; only those that pass are candidates
UNKNOWN = 0.25  # weight against a pattern of an instance of no known kind
BARE = "^S [9#]+$"  # the shape of a plain number, which alone supports no candidate without a check digit
LONGEST = 320  # characters of a mention that has a shape; emails have at most 254
GROUP = 256  # matches of a text whose places are summed up together
PATTERN_CHARS = 64  # longer patterns are told apart by a hash

MATCH = "struct<s:int,e:int,v:string,before:string,after:string>"


def is_valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def shaped_kinds(core: Column) -> Column:
    """array<int>: the kinds that a mention can be of, more loosely than the base patterns."""
    digits = F.length(F.regexp_replace(core, "[^0-9]", ""))
    loose = [
        F.regexp_like(core, F.lit(r"^[^@]++@[^@]*\.[^@]++$")),
        F.regexp_like(core, F.lit(r"^[0-9A-Fa-f]+(?:[.:][0-9A-Fa-f]*){3,}$")),
        digits.between(12, 19) & F.regexp_like(core, F.lit(r"^[0-9 .-]++$")),
        digits.between(7, 15) & F.regexp_like(core, F.lit(r"^[0-9 ().+-]++$")),
        F.regexp_like(core, F.lit(MIXED + r"[0-9A-Za-z+/_-]{12,}$")),
    ]
    kinds = F.array_compact(F.array(*[F.when(test, F.lit(i)) for i, test in enumerate(loose)]))
    return F.when(F.length(core).between(5, LONGEST), kinds).otherwise(F.array().cast("array<int>"))


def seed_kinds(core: Column) -> Column:
    """array<int>: the kinds that a mention is by the base rules, or by a public format."""
    whole = {**PATTERNS, "card": r"[0-9](?:[\x20-]?[0-9])+"}
    tests = [F.regexp_like(core, F.lit(f"^(?:{whole[k]})$")) & is_valid(k, core) for k in KINDS]
    tests.append(F.regexp_like(core, F.lit(SECRET)))
    return F.array_compact(F.array(*[F.when(test, F.lit(i)) for i, test in enumerate(tests)]))


def failed_kinds(core: Column) -> Column:
    """array<int>: the kinds whose check digit a mention fails, which tells against them."""
    digits = F.regexp_replace(core, "[^0-9]", "")
    card = F.regexp_like(core, F.lit(r"^[0-9][0-9 .-]++$")) & ~F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    return F.array_compact(F.array(F.when(card, F.lit(CARD))))


def shape(core: Column) -> Column:
    """What a mention looks like: the alphabet of long mixed codes, else classes of
    characters, where runs of four digits or more have their length."""
    classes = core
    for pattern, to in ((r"(?<![0-9])[0-9]{1,3}(?![0-9])", "#"), ("[0-9]", "9"), (r"\p{Lu}+", "A"), (r"\p{L}+", "a")):
        classes = F.regexp_replace(classes, pattern, to)
    code = lambda letters: F.regexp_like(core, F.lit(MIXED + f"[0-9{letters}]{{12,}}$"))
    return F.when(code("a-f"), "hex").when(code("A-Z"), "upper").when(code("A-Za-z"), "code").otherwise(classes)


def once(value: Column, of) -> Column:
    """``of`` of a value that is computed once, however often ``of`` uses it."""
    return F.transform(F.array(value), of)[0]


def matches(text: Column, found: Column, pieces: Column, beside: bool = False) -> Column:
    """array<MATCH> from the matches of a pattern and the pieces of text between them.

    Positions are running sums of the pieces' and matches' lengths, in code points:
    first within groups of GROUP matches, then of the groups, so that a text with very
    many matches takes time in proportion to them. With ``beside``, also the whole words
    next to a match: two before, one after.
    """
    empty = F.array().cast(f"array<{MATCH}>")
    n = F.size(found)
    sides = F.zip_with(F.slice(pieces, 1, n), F.slice(pieces, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    steps = F.zip_with(sides, found, lambda p, v: F.struct(p["a"].alias("a"), p["b"].alias("b"), v.alias("v")))

    def hit(s: Column, e: Column, x: Column, before: Column, after: Column) -> Column:
        return F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"), before.alias("before"), after.alias("after")).cast(MATCH)

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["a"])
        e = s + F.length(x["v"])
        before, after = F.lit(""), F.lit("")
        if beside:
            before = F.regexp_extract(x["a"], r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){1,2}+$", 0)
            after = F.regexp_extract(x["b"], r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)", 1)
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(hit(s, e, x, before, after))).alias("out"))

    def groups(all_steps: Column) -> Column:
        own = lambda i: F.aggregate(F.slice(all_steps, i * GROUP + 1, GROUP), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / GROUP).cast("int")), own)

    def shifted(acc: Column, group: Column) -> Column:
        return F.struct((acc["at"] + group["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("base"), group["out"].alias("out")))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<base:int,out:array<{MATCH}>>>").alias("out"))
    placed = F.aggregate(once(steps, groups), start, shifted, lambda acc: acc["out"])
    moved = F.flatten(F.transform(placed, lambda g: F.transform(g["out"], lambda x: hit(x["s"] + g["base"], x["e"] + g["base"], x, x["before"], x["after"]))))
    return F.when(n > 0, moved).otherwise(empty)


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of k, s, e), mentions (array<MATCH>)."""
    df = docs.select("doc_id", text_of(docs).alias("body"))
    needed = {"email": F.contains("body", F.lit("@")), "phone": F.contains("body", F.lit("+"))}
    patterns = {**PATTERNS, "mention": MENTION}
    for kind, pattern in patterns.items():
        found = F.regexp_extract_all("body", F.lit(pattern), F.lit(0))
        df = df.withColumn(f"m_{kind}", F.when(needed[kind], found).otherwise(F.array().cast("array<string>")) if kind in needed else found)
    for kind, pattern in patterns.items():
        pieces = F.when(F.size(f"m_{kind}") > 0, F.split("body", pattern, -1))
        df = df.withColumn(f"p_{kind}", pieces)
    df = df.select("doc_id", *[matches(F.col("body"), F.col(f"m_{k}"), F.col(f"p_{k}"), k == "mention").alias(k) for k in patterns])

    def checked(number: int, kind: str) -> Column:
        valid = F.filter(F.col(kind), lambda x: is_valid(kind, x["v"]))
        return F.transform(valid, lambda x: F.struct(F.lit(number).alias("k"), x["s"].alias("s"), x["e"].alias("e")))

    kept = [checked(i, k) for i, k in enumerate(KINDS)]
    return df.select("doc_id", F.concat(*kept).alias("base"), F.col("mention").alias("mentions"))


def mentions_of(spans: DataFrame) -> DataFrame:
    """row, s, e (of the mention without what it is assigned to or enclosed in), instance
    (in lower case), kinds, seeds, failed (array<int>), patterns (array<string>), for every
    mention of a checkpointed :func:`with_spans` that has the shape of a kind."""
    rows = spans.select("row", F.explode("mentions").alias("x")).select("row", "x.*")
    # digits in groups keep their bracket or plus; what encloses a word goes
    rows = rows.withColumn("head", F.regexp_extract("v", HEAD, 0)).withColumn("core", F.regexp_replace(F.expr("substr(v, length(head) + 1)"), r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", ""))
    rows = rows.withColumn("s", F.col("s") + F.length("head")).withColumn("e", F.col("s") + F.length("core")).withColumn("kinds", shaped_kinds(F.col("core"))).where(F.size("kinds") > 0)
    left = F.array_compact(F.transform(F.split(F.lower("before"), r"[\x20\x09-\x0D]++"), lambda w: F.nullif(w, F.lit(""))))
    rows = rows.withColumn("left", left).withColumn("l1", F.get("left", F.size("left") - 1)).withColumn("r1", F.nullif(F.lower("after"), F.lit("")))
    named = {
        "L": F.col("l1"),
        "M": F.when(F.size("left") == 2, F.array_join("left", " ")),
        "R": F.col("r1"),
        "B": F.when(F.col("l1").isNotNull() & F.col("r1").isNotNull(), F.concat_ws(" _ ", "l1", "r1")),
        "H": F.nullif(F.regexp_extract(F.lower("head"), r"[\p{L}\p{N}].*", 0), F.lit("")),
        "S": shape(F.col("core")),
    }
    short = lambda c: F.when(F.length(c) > PATTERN_CHARS, F.md5(c)).otherwise(c)
    patterns = F.array_compact(F.array(*[F.concat(F.lit(f"{n} "), short(c)) for n, c in named.items()]))
    return rows.select("row", "s", "e", F.lower("core").alias("instance"), "kinds", seed_kinds(F.col("core")).alias("seeds"), failed_kinds(F.col("core")).alias("failed"), patterns.alias("patterns"))


def bootstrap(mentions: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_instances: int = MIN_INSTANCES, min_score: float = MIN_SCORE, unknown: float = UNKNOWN, hidden: Column | None = None) -> DataFrame:
    """(k, instance): the seeds, and the unseen identifiers that the rounds discover.

    ``mentions`` is a checkpointed :func:`mentions_of`. Seeds of which ``hidden`` (a
    condition on the instance) holds are treated as unknown, to measure how many are
    found again. Without seeds the result is empty.
    """
    seen = F.lit(True) if hidden is None else ~hidden
    instances = checkpointed(mentions.groupBy("instance").agg(F.min("kinds").alias("kinds"), F.min("failed").alias("failed"), F.min(F.when(seen, F.col("seeds"))).alias("seeds")))
    known = checkpointed(instances.select(F.explode("seeds").alias("k"), "instance"))
    # (pattern, instance) once, whatever the number of mentions; patterns of too few instances can't count
    graph = mentions.select(F.explode("patterns").alias("pattern"), "instance").distinct()
    able = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_instances).select("pattern")
    graph = graph.join(able, "pattern").join(instances.select("instance", "failed", F.explode("kinds").alias("k")), "instance")
    graph = checkpointed(graph.select("k", "pattern", "instance", F.array_contains("failed", F.col("k")).alias("fails")))
    found = known.count()
    while found:
        kinds = known.groupBy("instance").agg(F.collect_set("k").alias("known"))  # at most one for each kind
        judged = graph.join(kinds, "instance", "left")
        own = F.coalesce(F.array_contains("known", F.col("k")), F.lit(False))
        against, open_ = ~own & F.col("known").isNotNull(), F.col("known").isNull()
        trusted = (
            judged.groupBy("k", "pattern")
            .agg(F.count_if(own).alias("own"), F.count_if(against).alias("other"), F.count_if(open_ & ~F.col("fails")).alias("open"), F.count_if(open_ & F.col("fails")).alias("failing"))
            .where(F.col("own") >= min_instances)
            .select("k", "pattern", (F.col("own") / (F.col("own") + F.col("other") + unknown * F.col("open") + LUCK * F.col("failing"))).alias("confidence"))
            .where(F.col("confidence") >= min_confidence)
        )
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        new = (
            judged.where(F.col("known").isNull() & ~F.col("fails"))
            .join(small(checkpointed(trusted)), ["k", "pattern"])
            .groupBy("k", "instance")
            .agg((1 - doubt).alias("score"), F.max(~F.regexp_like("pattern", F.lit(BARE)) | (F.col("k") == CARD)).alias("supported"))
            .where((F.col("score") >= min_score) & F.col("supported"))
            .select("k", "instance")
        )
        new = checkpointed(new)
        found = new.count()
        known = checkpointed(known.union(new)) if found else known
    return known


def spans_text(spans: Column) -> Column:
    """kind:start:end of (k, s, e) sorted by kind, then start, joined by commas."""
    name = F.array(*[F.lit(k) for k in FOUND_KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def detect(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and found, arrays of (k, s, e) with k
    the kind's number in FOUND_KINDS; positions are code points, the end exclusive.

    A null or empty text has no spans, an empty table no rows; rows that repeat are
    judged alike; of very long texts every mention counts, and neighbouring words are
    whole words whatever their length; other columns of ``docs``, whatever their
    names, aren't read. Base spans never change. A mention that a base span touches
    is never found; one that scores as several kinds (a tie) is found as each.
    """
    spans = checkpointed(with_spans(docs).withColumn("row", F.monotonically_increasing_id()))
    mentions = checkpointed(mentions_of(spans))
    known = bootstrap(mentions, **options)
    place = F.struct("k", "s", "e")
    hits = mentions.where(F.size("seeds") == 0).join(small(known), "instance")
    secrets = mentions.select("row", "s", "e", F.explode("seeds").alias("k")).where(F.col("k") >= len(KINDS))
    hits = hits.select("row", "k", "s", "e").union(secrets.select("row", "k", "s", "e")).groupBy("row").agg(F.collect_list(place).alias("found"))
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    apart = F.filter("found", lambda f: ~F.exists("base", lambda b: (b["s"] < f["e"]) & (f["s"] < b["e"])))
    return spans.select("row", "doc_id", "base").join(hits, "row", "left").select("doc_id", "base", F.coalesce(apart, none).alias("found"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row of ``documents``: doc_id, the numbers of base spans by kind, the digest
    of the base spans, all spans, and the number of spans that the bootstrap adds.
    Null, empty, very long and repeated texts as in :func:`detect`."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # a second parameter of the function would be the place in the array
    number = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")
    counts = [number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
        F.size(F.concat("base", "found")).cast("long").alias("n_spans"),
    )
