"""Secrets in texts by a trigram inverted index, in DataFrame functions only.

Each rule's expression is turned into a Boolean query of trigrams that every match must hold. One search of
each text gives its postings: the trigrams that some query asks for. Postings of a query's alternative are
intersected per text (bits of the trigrams seen, combined in tasks); a text that has all of an alternative is a
candidate of the rule, and only candidates are searched with the expression. Rules whose expression has no
mandatory trigram search every text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import ids_and_texts
from ticketlens.llm.personal_data import _let, _matches
from ticketlens.llm.trigrams import ALWAYS, as_alternation, trigram_query
from ticketlens.session import reliable_checkpoint


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose group `group` has at least `least` characters; the rest is dropped, not retried.

    `search` may give a faster expression with exactly the spans that are left.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    search: str | None = None


# --- Fixed values: base rules --------------------------------------------------
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32, search=r"(?<![0-9a-f])[0-9a-f]{32,}+"),
)
# --- Fixed values: public formats of keys that the method adds --------------------
ADDED = (
    Rule(
        "private_key",
        r"-----BEGIN[A-Z\x20]*\x20PRIVATE\x20KEY-----[A-Za-z0-9+/=\x09-\x0D\x20]*(?:-----END[A-Z\x20]*\x20PRIVATE\x20KEY-----)?",
    ),
    Rule("repository_token", r"gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abp]-[A-Za-z0-9-]+", 20),
    Rule("service_key", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("payment_key", r"[rs]k_(?:live|test)_[A-Za-z0-9]+", 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"[Bb]earer\x20+([A-Za-z0-9._=-]+)", 20, 1),
    Rule("url_password", r"://[A-Za-z0-9._%+-]+:([A-Za-z0-9._%+!$&*=~-]+)@", 3, 1),
)
RULES = BASE + ADDED
# ------------------------------------------------------------------------------

#: Up to so many candidates are broadcast (two longs each); beyond, candidates and texts are shuffled.
BROADCAST_CANDIDATES = 1 << 20

_SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Spans (start, end, kind, value) of one rule in `text`; places count code points, ends exclusive."""
    found = _matches(text, rule.search or rule.pattern)
    if rule.least and not rule.search:
        held = lambda value: F.regexp_extract(value, rule.pattern, rule.group)
        found = F.filter(found, lambda match: F.length(held(match["value"])) >= rule.least)
    return F.transform(
        found,
        lambda match: F.struct(
            match["start"].alias("start"),
            (match["start"] + F.length(match["value"])).alias("end"),
            F.lit(number).alias("kind"),
            match["value"].alias("value"),
        ),
    ).cast(_SPAN)


def _escape(character: str) -> str:
    return f"\\x{ord(character):02x}"


def postings(texts: DataFrame, wanted: frozenset[str]) -> DataFrame:
    """(trigram, key): which of the `wanted` lower-case trigrams each text holds.

    `key` is a hash of id and text. Two texts with one key would share their postings, which can
    only make candidates more.
    """
    search = "(?=(" + as_alternation(wanted, _escape) + "))"
    found = F.regexp_extract_all(F.lower("text"), F.lit(search), F.lit(1))
    rows = texts.select(F.xxhash64("doc_id", "text").alias("key"), F.array_distinct(found).alias("found"))
    return rows.select(F.explode("found").alias("trigram"), "key")


def candidates(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, may): the rules (as bits) whose trigram query the text of that key fulfils.

    Rules without mandatory trigrams are not among them.
    """
    spark = texts.sparkSession
    parts, wanted = [], set()
    for number, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if query != ALWAYS:
            for which, all_of in enumerate(sorted(map(sorted, query))):
                wanted.update(all_of)
                whole = (1 << len(all_of)) - 1
                parts += [(t, number, which, 1 << i, whole) for i, t in enumerate(all_of)]
    if not parts:
        return spark.createDataFrame([], "key long, may long")
    # A few hundred rows: the trigrams of the rules.
    asked = spark.createDataFrame(parts, "trigram string, rule int, alternative int, bit long, whole long")
    met = postings(texts, frozenset(wanted)).join(F.broadcast(asked), "trigram")
    seen = met.groupBy("key", "rule", "alternative", "whole").agg(F.bit_or("bit").alias("seen"))
    hits = seen.where("seen = whole").select("key", F.expr("shiftleft(1L, rule)").alias("bit"))
    return hits.groupBy("key").agg(F.bit_or("bit").alias("may"))


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """(doc_id, spans): array of (start, end, kind, value), by start and then kind, for each row of `docs`.

    `kind` is the number of the rule in `rules`, of which there may be 62. Spans of one rule do not overlap, spans of
    different rules may. Null and empty texts have no spans; ids may repeat or be null, each row gives its
    own; an empty table gives none. Texts are searched whole. Other columns of `docs` play no part.
    """
    if len(rules) > 62:
        raise ValueError("more rules than bits")
    texts = ids_and_texts(docs, id_col, text_col)
    found = reliable_checkpoint(candidates(texts, rules))
    keyed = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    small = found.count() <= BROADCAST_CANDIDATES
    rows = keyed.join(F.broadcast(found) if small else found, "key", "left")
    text, none, spans = F.col("text"), F.array().cast(_SPAN), []
    for number, rule in enumerate(rules):
        of_rule = rule_spans(text, rule, number)
        if trigram_query(rule.pattern) == ALWAYS:
            test = F.rlike(text, F.lit(rule.search or rule.pattern))
        else:
            test = F.col("may").bitwiseAND(F.lit(1 << number)) != 0
        spans.append(F.when(test, of_rule).otherwise(none))
    keys = ("start", "kind", "end", "value")
    ordered = F.array_sort(F.transform(F.concat(*spans), lambda s: F.struct(*[s[k].alias(k) for k in keys])))
    return rows.select("doc_id", ordered.alias("spans"))


def _written(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(rule.kind) for rule in rules])
    each = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(each, ",")


def span_digests(spans: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """(doc_id, n_<kind> of the first `base` rules, base_sha256, spans) of the result of `secret_spans`."""

    def digests(found: Column) -> Column:
        own = F.filter(found, lambda s: s["kind"] < base)
        counts = [
            F.size(F.filter(own, _of_kind(i))).cast("long").alias(f"n_{rules[i].kind}") for i in range(base)
        ]
        return F.struct(
            *counts, F.sha2(_written(own, rules), 256).alias("base_sha256"), _written(found, rules).alias("spans")
        )

    return spans.select("doc_id", _let(F.col("spans"), digests).alias("digests")).select("doc_id", "digests.*")


def _of_kind(i: int):
    return lambda span: span["kind"] == i


def spans_sql(rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> str:
    """SQL for the rows of `span_digests`, which tries every rule on every text."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    names = [rule.kind for rule in rules]
    found, spans = [], []
    for kind, rule in zip(names, rules):
        p = quoted(rule.pattern)
        found.append(f"regexp_extract_all(text, {p}) AS m_{kind}, regexp_split_to_array(text, {p}) AS g_{kind}")
        long = f"length(regexp_extract(m_{kind}[i], {p}, {rule.group})) >= {rule.least}"
        spans.append(
            f"list_transform(list_filter(range(1, len(m_{kind}) + 1), lambda i: {long}), lambda i: {{"
            f"'s': coalesce(list_sum(list_transform(g_{kind}[1:i], lambda x: length(x))), 0)"
            f" + coalesce(list_sum(list_transform(m_{kind}[1:i - 1], lambda x: length(x))), 0),"
            f" 'k': {names.index(kind)}, 'n': length(m_{kind}[i])}})"
        )
    labels = "[" + ", ".join(map(quoted, names)) + "]"
    written = (
        "array_to_string(list_transform({}, lambda s: {}[s.k + 1] || ':' || CAST(s.s AS BIGINT) || ':' ||"
        " CAST(s.s + s.n AS BIGINT)), ',')"
    )
    own = f"list_filter(spans, lambda s: s.k < {base})"
    counts = ", ".join(f"len(list_filter(spans, lambda s: s.k = {i})) AS n_{names[i]}" for i in range(base))
    return (
        "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), "
        f"f AS (SELECT doc_id, {', '.join(found)} FROM t), "
        f"s AS (SELECT doc_id, list_sort(list_concat({', '.join(spans)})) AS spans FROM f) "
        f"SELECT doc_id, {counts}, sha256({written.format(own, labels)}) AS base_sha256, "
        f"{written.format('spans', labels)} AS spans FROM s"
    )
