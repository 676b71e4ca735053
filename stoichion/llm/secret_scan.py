"""Secret scan by a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression; its Boolean trigram query (alternatives of trigrams that any match must hold) is
derived from the expression. The index keeps a posting (trigram, text) for each trigram that some rule asks for;
postings are intersected for each alternative, and only texts that survive are searched by the rule itself. Rules that
demand no trigram (`hex`) search every text.

Spans are code point ranges, end exclusive, leftmost and non-overlapping for each rule. Where a rule has `least`, matches
whose group of that number is shorter than the given length are dropped after matching.

Defined results: a null text is empty and has no span; spans of different rules may overlap and all stay; repeated rows
each get their row; two rules at one place stand in the order of the rules; other columns pass through, but a column named
`spans` is replaced by scan(); redact() keeps all columns, whatever their names; texts of any length are read whole, with
work in proportion to text and matches; an empty table gives an empty one.

Scale: postings exist only for the rules' own trigrams and are combined to one row for each text and alternative
before they are shuffled; they carry bit masks that are or-ed, so repeated rows don't matter. Texts move once, to meet their
candidates, keyed by a hash of the text; a chance collision merely adds a candidate, which the rule then refutes. What
is broadcast is the rule table, bounded by the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoichion.llm.keys import field, packed
from stoichion.llm.trigram_query import trigram_query


@dataclass(frozen=True)
class Rule:
    """least: (group, length), matches with a shorter group are dropped."""

    kind: str
    pattern: str
    least: tuple[int, int] | None = None


# The kinds and expressions of known secrets. `{16,}` and `{14,}` equal `+` with shorter matches dropped,
# as those take whole runs of their class.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (2, 12)),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_password", r"://[A-Za-z0-9._~-]+:[A-Za-z0-9._~!$&*+=-]+@"),
]
RULES = [*BASE, *MORE]
#: What follows the first line of a private key: all up to its END line or, where another such line or none comes first, the
#: base64 lines and key headers right after it. Possessive, so that no text is too long for the matcher's stack.
KEY_BODY = r"(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----|(?:\s++(?:[A-Za-z0-9+/=]{16,}+|(?:Proc-Type|DEK-Info):[^\n]*+|(?<=\n)[A-Za-z0-9+/=]++(?=[ \t\r]*+(?![^\n]))))*+)"
#: What redact() searches for: RULES, private keys with their body.
REDACTED = [replace(r, pattern=r.pattern + KEY_BODY) if r.kind == "private_key" else r for r in RULES]
#: Tasks that copies of one text are dealt to, by the other columns of these types; candidates are few and go to all of them.
SALTS, PLAIN = 16, ("bigint", "int", "smallint", "string", "double", "date", "timestamp")
#: Matches that are added up one by one, and characters of a chunk of text.
BLOCK, CHUNK = 64, 1024
#: What redact() writes in place of a secret.
MASK = "[SECRET]"


def postings(texts: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """(text_hash, trigram): which of the trigrams each text holds, A-Z lower-cased."""
    low = F.lower(F.col(text))
    held = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    return texts.select(F.xxhash64(text).alias("text_hash"), low.alias("_low")).select("text_hash", F.explode(held).alias("trigram"))


def candidates(texts: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """(text_hash, rules): numbers of the rules whose trigram queries a text meets."""
    queries = [(r, i, alternative) for r, rule in enumerate(rules) for i, alternative in enumerate(trigram_query(rule.pattern) or [])]
    trigrams = sorted({t for _, _, own in queries for t in own})
    rows = [(trigrams.index(t), r, i, 1 << bit, (1 << len(own)) - 1) for r, i, own in queries for bit, t in enumerate(sorted(own))]
    table = texts.sparkSession.createDataFrame(rows, "trigram int, rule int, alternative int, bit bigint, every bigint")
    met = postings(texts, trigrams, text).join(F.broadcast(table), "trigram").groupBy("text_hash", "rule", "alternative", "every").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = every").groupBy("text_hash").agg(F.collect_set("rule").alias("rules"))


def _before(df: DataFrame, values: str, out: str, merge: Callable[[Column, Column], Column]) -> DataFrame:
    """df with out: for each element of an array of bigint, what merge (from 0 on) makes of those before it. Elements are merged in blocks, and
    blocks before that, so that growing arrays stay short and the work is linear for any number that a text can have. values and what is made of
    it are columns of their own, each named more than once, as they would else be computed anew for each block.
    """
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")
    n = F.size(values)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(F.col(values), b * BLOCK + 1, F.lit(BLOCK)))
    df = df.withColumn("_blocks", F.when(n > 0, cut).otherwise(F.array().cast("array<array<bigint>>")))

    def grown(own: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(own, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    firsts = grown(F.transform("_blocks", lambda own: F.aggregate(own, zero, merge)), zero)
    return df.withColumn(out, F.flatten(F.zip_with("_blocks", firsts, grown))).drop("_blocks")


def _placed(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with spans, an array of (start, rule, end), from the matches _m0, ... of each rule and the pieces between them _c0, ..."""
    none = F.array().cast("array<struct<rule:int,gap:bigint,size:bigint,good:boolean>>")

    def hits(i: int, rule: Rule) -> Column:
        least = rule.least[1] if rule.least else 0
        one = lambda p, m: F.struct(F.lit(i).alias("rule"), F.length(p).cast("bigint").alias("gap"), F.length(m["hit"]).cast("bigint").alias("size"), (F.length(m["own"]) >= least).alias("good"))
        return F.when(F.size(f"_m{i}") > 0, F.zip_with(F.slice(F.col(f"_c{i}"), F.lit(1), F.size(f"_m{i}")), F.col(f"_m{i}"), one)).otherwise(none)

    own = [hits(i, rule) for i, rule in enumerate(rules)]
    df = df.select("row", "text", F.array(*own).alias("_own")).withColumn("_hits", F.flatten("_own"))
    df = df.withColumn("_sizes", F.transform("_hits", lambda x: x["gap"] + x["size"]))
    total = F.transform("_own", lambda hits: F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, x: a + x["gap"] + x["size"]))
    # All rules are added up together; what stands before a rule's first match belongs to the others.
    df = _before(df.withColumn("_totals", F.when(F.size("_hits") > 0, total).otherwise(F.array().cast("array<bigint>"))), "_totals", "_first", lambda a, x: a + x)
    df = _before(df, "_sizes", "_at", lambda a, x: a + x)
    start = lambda x, at: at - F.get("_first", x["rule"]) + x["gap"]
    placed = F.zip_with("_hits", "_at", lambda x, at: F.struct(start(x, at).cast("int").alias("start"), x["rule"].alias("rule"), (start(x, at) + x["size"]).cast("int").alias("end"), x["good"].alias("good")))
    df = df.withColumn("_placed", placed)
    return df.select("row", "text", F.sort_array(F.transform(F.filter("_placed", lambda x: x["good"]), lambda x: F.struct(x["start"].alias("start"), x["rule"].alias("rule"), x["end"].alias("end")))).alias("spans"))


def scan(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with spans: array of (start, rule, end), rule being the number in the list of rules."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "spans"]
    return scanned(docs, text, rules, keep).select(*((F.col("text") if c == text else field(c)).alias(c) for c in keep), "spans")


def scanned(docs: DataFrame, text: str, rules: list[Rule] | None, keep: list[str]) -> DataFrame:
    """(row, text, spans): the columns keep of docs but the text as a struct, the text, and its spans."""
    rules = RULES if rules is None else rules
    own = F.col(f"`{text}`")
    found = candidates(docs.where(own.isNotNull()).select(own.alias("text")), rules)
    kept = docs.select(*(f"`{c}`" for c in keep))
    plain = [F.col(f"`{c}`") for c, k in kept.dtypes if k in PLAIN]
    salt = F.pmod(F.xxhash64(*plain, F.lit(0)), F.lit(SALTS))
    keyed = docs.select(packed(kept, text).alias("row"), own.alias("text"), F.xxhash64(F.coalesce(own, F.lit(""))).alias("text_hash"), salt.alias("salt"))
    found = found.select("text_hash", "rules", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    df = keyed.join(found.hint("shuffle_hash"), ["text_hash", "salt"], "left").select("row", "text", F.coalesce("text", F.lit("")).alias("full"), F.coalesce("rules", F.array().cast("array<int>")).alias("may"))
    none = F.array().cast("array<struct<hit:string,own:string>>")
    for i, rule in enumerate(rules):
        may = F.array_contains("may", i) if trigram_query(rule.pattern) else F.lit(True)
        hit = F.regexp_extract_all("full", F.lit(rule.pattern), F.lit(0))
        own = F.regexp_extract_all("full", F.lit(rule.pattern), F.lit(rule.least[0])) if rule.least else hit
        pairs = F.zip_with(hit, own, lambda a, b: F.struct(a.alias("hit"), b.alias("own")))
        df = df.withColumn(f"_m{i}", F.when(may, pairs).otherwise(none))
    df = df.withColumns({f"_c{i}": F.when(F.size(f"_m{i}") > 0, F.split("full", rule.pattern, -1)) for i, rule in enumerate(rules)})
    return _placed(df, rules)


def span_text(spans: Column | str, rules: list[Rule]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rule"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, mask: str = MASK) -> DataFrame:
    """docs with every secret of its texts replaced by mask, private keys whole; its own columns only."""
    df = scanned(docs, text, REDACTED if rules is None else rules, docs.columns)
    df = _before(df.withColumn("_ends", F.transform("spans", lambda x: x["end"].cast("bigint"))), "_ends", "_at", lambda a, x: F.greatest(a, x))
    # Text is read by chunks, as a place in a text is found by counting characters from its start.
    df = df.withColumn("_chunks", F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))

    def part(start: Column, end: Column) -> Column:
        first, last = F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")
        held = F.array_join(F.slice(F.col("_chunks"), first + 1, last - first + 1), "")
        return F.when(end > start, F.substring(held, (start % CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise("")

    clear = F.filter(F.zip_with("spans", "_at", lambda x, at: F.struct(at.alias("at"), x["start"].cast("bigint").alias("start"))), lambda x: x["start"] >= x["at"])
    df = df.withColumn("_clear", clear)
    tail = part(F.array_max("_ends"), F.length("text").cast("bigint"))
    cut = F.concat(F.array_join(F.transform("_clear", lambda x: F.concat(part(x["at"], x["start"]), F.lit(mask))), ""), tail)
    whole = F.when(F.size("spans") > 0, cut).otherwise(F.col("text"))
    return df.select(*((whole if c == text else field(c)).alias(c) for c in docs.columns))
