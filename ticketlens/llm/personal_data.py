"""Personal data by weak supervision, in DataFrame functions only.

Base spans (e-mail and network addresses, payment cards, international telephone numbers) follow fixed
patterns and always stay. Looser patterns propose further spans: secrets, account numbers, telephone numbers
without a country code. Four labelers vote on every span, each for, against or not at all: its format, word and
prefix lists, the words before it, and its shape. Expectation-maximisation over the counts of vote
combinations estimates how reliable each labeler is (Dawid, Skene 1979); its posteriors train a logistic
classifier over votes, kind and length, which is compiled into a column and decides on the proposed
spans. Only counts of combinations reach the driver, a few thousand at most whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import ids_and_texts
from ticketlens.session import reliable_checkpoint

# --- Fixed values: kinds and patterns -----------------------------------------
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "account", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS

#: The patterns give the leftmost matches of the plain forms named beside them. What stands before
#: a match keeps the search from starting again at every character of a long run.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+ where it has 12 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = {
    "secret": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
    r"|(?:ghp_|xox[bp]-|sk-)[0-9A-Za-z-]{16,}"
    r"|(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']?[^\s\"',;]{6,}+",
    "account": r"(?<![0-9A-Za-z.+-])(?:[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8,24})(?![0-9A-Za-z-])",
    "local_phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}
#: A text without any of these holds no match of the kind.
NEEDED = {"email": "@", "phone": "+"}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel|schreib)",
    "ip": r"(?i)\b(?:ip|host|server|addr|login|from)\b",
    "card": r"(?i)\b(?:card|visa|master|credit|pay|tarjeta|carte|karte)",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|contact|m[oó]vil|t[eé]l[eé]phone|telefon)",
    "secret": r"(?i)\b(?:key|token|secret|pass|credential|login|auth)",
    "account": r"(?i)\b(?:account|iban|acct|ssn|social security|passport|konto|cuenta|compte|id number)\b",
    "local_phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|contact|m[oó]vil|t[eé]l[eé]phone|telefon)",
}
TOP_LEVEL_DOMAINS = ("com", "net", "org", "edu", "gov", "io", "info", "de", "fr", "es", "it", "uk", "eu", "us", "ca")
COUNTRY_CODES = r"^\+(?:1|7|20|27|3[0-4]|36|39|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
SECRET_PREFIXES = r"^(?:AKIA|ASIA|ghp_|xox[bp]-|sk-)"
UNROUTED_ADDRESSES = r"^(?:0|10|127|255|192\.168|169\.254)\."
# ------------------------------------------------------------------------------

#: Characters before a span that the context labeler looks at.
CONTEXT = 40
LABELERS = ("format", "lists", "context", "shape")
#: Lengths below these make the length classes of the classifier.
LENGTH_STEPS = (10, 14, 18, 24, 40)
ACCEPT = 0.5
#: Weight of the penalty of the span classifier.
RIDGE = 0.1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, x: total + x)


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, value): all matches with their places in code points."""
    block = 64
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(both: Column) -> Column:
        before = F.concat(F.array(F.lit("")), both["found"])
        # Step i: from the start of match i - 1 to the start of match i.
        steps = F.zip_with(both["gaps"], before, lambda gap, last: F.length(gap) + F.length(last))
        return _let(steps, lambda s: F.struct(s.alias("s"), blocks(s).alias("b"), both["found"].alias("found")))

    def blocks(steps: Column) -> Column:
        last = F.floor((F.size(steps) - 1) / block).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last), lambda i: _total(F.slice(steps, i * block + 1, block))
        )

    def starts(sums: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            whole = F.floor((i + 1) / block).cast("int")
            start = _total(F.slice(sums["b"], 1, whole)) + _total(
                F.slice(sums["s"], whole * block + 1, i + 1 - whole * block)
            )
            return F.struct(start.alias("start"), value.alias("value"))

        return F.transform(sums["found"], one)

    return _let(F.struct(found.alias("found"), gaps.alias("gaps")), lambda both: _let(placed(both), starts))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.split(_digits(value), ""))

    def part(digit: Column, i: Column) -> Column:
        twice = digit.cast("int") * 2
        return F.when(i % 2 == 0, digit.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return _total(F.transform(digits, part)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", ""))
        return F.forall(parts, lambda part: (F.length(part) <= 3) & (part.cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def _spans(text: Column, kind: str) -> Column:
    pattern = PATTERNS.get(kind) or PROPOSED[kind]
    found = _matches(text, pattern)
    if kind in PATTERNS:
        found = F.filter(found, lambda match: _holds(kind, match["value"]))
    spans = F.transform(
        found,
        lambda match: F.struct(
            match["start"].alias("start"),
            (match["start"] + F.length(match["value"])).alias("end"),
            F.lit(KINDS.index(kind)).alias("kind"),
            match["value"].alias("value"),
        ),
    ).cast(_SPAN)
    none = F.array().cast(_SPAN)
    if kind in NEEDED:
        return F.when(F.contains(text, F.lit(NEEDED[kind])), spans).otherwise(none)
    # One search decides whether there is anything to place.
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)


def _vote(positive: Column, negative: Column) -> Column:
    return F.when(positive, 1).when(negative, -1).otherwise(0)


def _votes(text: Column, span: Column) -> list[Column]:
    """The votes of LABELERS on one span."""
    value, kind = span["value"], span["kind"]
    is_kind = lambda name: kind == KINDS.index(name)
    no = F.lit(False)
    digits = _digits(value)
    tidy = F.rlike(value, F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}"))
    quoted = F.rlike(value, F.lit(r"[=:]")) & F.rlike(value, F.lit(r"[0-9]"))
    issued = F.rlike(value, F.lit(SECRET_PREFIXES))
    formats = (
        F.when(kind < len(BASE_KINDS), _vote(F.lit(True), no))
        .when(is_kind("secret"), _vote(issued | quoted, ~issued & ~quoted))
        .when(is_kind("account"), _vote(tidy, ~tidy))
        .otherwise(_vote(F.rlike(value, F.lit(r"^\([0-9]{3}\)")), no))
    )
    domain = F.rlike(value, F.lit(r"(?i)\.(?:" + "|".join(TOP_LEVEL_DOMAINS) + ")$"))
    lists = (
        F.when(is_kind("email"), _vote(domain, ~domain))
        .when(is_kind("ip"), _vote(no, F.rlike(value, F.lit(UNROUTED_ADDRESSES))))
        .when(is_kind("card"), _vote(F.rlike(digits, F.lit(CARD_ISSUERS)), no))
        .when(is_kind("phone"), _vote(F.rlike(value, F.lit(COUNTRY_CODES)), no))
        .when(is_kind("secret"), _vote(issued, no))
        .otherwise(F.lit(0))
    )
    first = F.greatest(span["start"] - CONTEXT, F.lit(0))
    before = F.substring(text, first + 1, span["start"] - first)
    cue = F.lit(False)
    for name in KINDS:
        cue = F.when(is_kind(name), F.rlike(before, F.lit(CUES[name]))).otherwise(cue)
    # A secret written as key=value has the word before it in the span.
    cue = cue | (is_kind("secret") & F.rlike(value, F.lit(r"^[^=:]*[A-Za-z][\"']?[\x20\t]*[=:]")))
    context = _vote(cue, ~cue & (is_kind("account") | is_kind("local_phone")))
    mixed = F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))
    varied = F.size(F.array_distinct(F.split(digits, ""))) > 3
    # Most numbers have more than three different digits; only having fewer tells something.
    shape = F.when(is_kind("secret") | is_kind("email"), _vote(mixed, ~mixed)).otherwise(_vote(no, ~varied))
    return [formats, lists, context, shape]


def candidate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of (start, end, kind, value) and, with them, votes and length class.

    `base` are the spans of the fixed patterns; `added` proposed ones that touch none of them.
    """
    texts = ids_and_texts(docs, id_col, text_col)
    text = F.col("text")
    base = F.array_sort(F.concat(*[_spans(text, kind) for kind in BASE_KINDS]))
    found = texts.withColumn("base", base).withColumn(
        "proposed", F.concat(*[_spans(text, kind) for kind in ADDED_KINDS])
    )

    def free(span: Column) -> Column:
        return ~F.exists(
            F.col("base"), lambda other: (other["start"] < span["end"]) & (span["start"] < other["end"])
        )

    def voted(span: Column) -> Column:
        votes = [vote.alias(name) for name, vote in zip(LABELERS, _votes(text, span))]
        size = F.length(span["value"])
        length = sum(F.when(size >= step, 1).otherwise(0) for step in LENGTH_STEPS)
        return F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            span["kind"].alias("kind"),
            span["value"].alias("value"),
            *votes,
            length.alias("length"),
        )

    return found.select(
        "doc_id",
        F.transform("base", voted).alias("base"),
        F.transform(F.filter("proposed", free), voted).alias("added"),
    )


def combination_counts(candidates: DataFrame) -> dict[tuple[int, ...], int]:
    """How often each combination of kind, votes and length class occurs.

    There are at most 7 kinds * 3^4 votes * 6 classes of them.
    """
    keys = ["kind", *LABELERS, "length"]
    spans = candidates.select(F.explode(F.concat("base", "added")).alias("span")).select(
        *[F.col(f"span.{key}").alias(key) for key in keys]
    )
    rows = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()
    return {tuple(row[key] for key in keys): row["n"] for row in rows}


def posteriors(counts: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Probability that a span of each combination is personal data, by expectation-maximisation.

    Labelers vote independently given the truth, each with its own reliability; each kind has its own share
    of true spans. A labeler that does not vote says nothing either way: word lists that know one form of a
    secret are no evidence against another. Counts are smoothed by the labelers' intent: they are right more
    often than not.
    """
    if not counts:
        return {}
    keys = sorted(counts)
    n = np.array([counts[key] for key in keys], float)
    kinds = np.array([key[0] for key in keys])
    votes = np.array([key[1 : 1 + len(LABELERS)] for key in keys]) + 1
    intent = np.array([[6.0, 0.0, 2.0], [1.0, 0.0, 8.0]])  # by truth: against, none, for
    base = kinds < len(BASE_KINDS)
    truth = np.where(base, 0.95, np.clip(0.5 + 0.2 * (votes - 1).sum(axis=1), 0.05, 0.95))
    for _ in range(rounds):
        log = np.zeros((2, len(keys)))
        for labeler in range(len(LABELERS)):
            voted = votes[:, labeler] != 1
            for y, weight in ((0, n * (1 - truth)), (1, n * truth)):
                seen = intent[y] + np.bincount(votes[:, labeler], weight * voted, 3)
                shares = np.maximum(seen / seen.sum(), 1e-300)
                log[y, voted] += np.log(shares)[votes[voted, labeler]]
        for kind in np.unique(kinds):
            at = kinds == kind
            share = (n[at] @ truth[at] + 1) / (n[at].sum() + 2)
            log[1, at] += np.log(share)
            log[0, at] += np.log(1 - share)
        truth = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return dict(zip(keys, truth.tolist()))


def _features(key: tuple[int, ...]) -> np.ndarray:
    kind, votes, length = key[0], key[1 : 1 + len(LABELERS)], key[-1]
    found = [1.0]
    found += [float(kind == i) for i in range(len(KINDS))]
    found += [float(vote == sign) for vote, sign in product(votes, (-1, 1))]
    found += [float(length == i) for i in range(len(LENGTH_STEPS) + 1)]
    return np.array(found)


def fit_classifier(counts: dict[tuple[int, ...], int], truth: dict[tuple[int, ...], float]) -> np.ndarray:
    """Weights of a ridge logistic regression on the posteriors, by Newton's method."""
    keys = sorted(counts)
    if not keys:
        return np.zeros(len(_features((0,) * (2 + len(LABELERS)))))
    x = np.array([_features(key) for key in keys])
    n = np.array([counts[key] for key in keys], float)
    y = np.array([truth[key] for key in keys])
    weights = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (y - p)) - RIDGE * weights
        curve = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + RIDGE * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _score(span: Column, weights: np.ndarray) -> Column:
    tests = [F.lit(True)]
    tests += [span["kind"] == i for i in range(len(KINDS))]
    tests += [span[name] == sign for name, sign in product(LABELERS, (-1, 1))]
    tests += [span["length"] == i for i in range(len(LENGTH_STEPS) + 1)]
    total = F.lit(0.0)
    for test, weight in zip(tests, weights.tolist(), strict=True):
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-total))


def _written(spans: Column) -> Column:
    """kind:start:end of the spans, by start and then kind, joined by commas."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    keys = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    texts = F.transform(
        keys, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(texts, ",")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): array of (start, end, kind, value, base, score) for each row of `docs`.

    Starts and ends count code points of the whole text, ends exclusive. Base spans always stay, with the score that
    the classifier gives them; proposed ones that touch a base span or score under ACCEPT are left out.
    Null and empty texts have no spans; ids may repeat or be null, each row gives its own; an empty table gives
    none. Other columns of `docs` play no part.
    """
    candidates = reliable_checkpoint(candidate_spans(docs, id_col, text_col))
    counts = combination_counts(candidates)
    weights = fit_classifier(counts, posteriors(counts))

    def scored(base: bool) -> Callable[[Column], Column]:
        return lambda span: F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            span["kind"].alias("kind"),
            span["value"].alias("value"),
            F.lit(base).alias("base"),
            _score(span, weights).alias("score"),
        )

    added = F.filter(F.transform("added", scored(False)), lambda span: span["score"] >= ACCEPT)
    return candidates.select("doc_id", F.concat(F.transform("base", scored(True)), added).alias("spans"))


def span_digests(spans: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of the result of `personal_spans`."""
    base = F.filter("spans", lambda span: span["base"])
    counts = [
        F.size(F.filter("spans", _of_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE_KINDS)
    ]
    return spans.select(
        "doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )


def _of_kind(i: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == i
