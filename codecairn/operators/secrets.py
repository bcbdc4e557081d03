"""Secret scan and masking. Rules are our own, over public token formats."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lookups import contains_any
from .ranking import top_n


class SecretRule(NamedTuple):
    """``pattern`` has three groups: text to keep, the secret, text to keep.

    Every match contains one of ``hints`` (lower case if ``any_case``). A plain substring
    search for them is far cheaper than the pattern and spares it most texts.
    """
    name: str
    pattern: str
    high_risk: bool
    hints: tuple
    any_case: bool = False


RULES = [
    SecretRule("Generic Secret Assignment",
               r"""((?i:key|secret|token|password)["']?\s*[:=]\s*["'])([^"'\s]{8,})(["'])""", False,
               ("key", "secret", "token", "password"), any_case=True),
    SecretRule("AWS Access Key ID", r"(\b)((?:AKIA|ASIA)[0-9A-Z]{16})(\b)", True, ("AKIA", "ASIA")),
    SecretRule("GitHub Token", r"(\b)(gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})(\b)", True,
               ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    SecretRule("Private Key", r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)((?s:.*?))(-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\z)", True, ("-----BEGIN ",)),
    SecretRule("JSON Web Token", r"(\b)(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})()", True, ("eyJ",)),
    SecretRule("URL With Password", r"([a-z][a-z0-9+.-]*://[^\s:@/]+:)([^\s:@/]+)(@)", True, ("://",)),
    # As in .env files: one unquoted assignment on a line of its own.
    SecretRule("Environment Assignment",
               r"""((?m:^)(?:export[ \t]+)?[A-Z][A-Z0-9_]*(?:KEY|SECRET|TOKEN|PASSWORD)[A-Z0-9_]*=)([^\s"'#$(){}]{8,})((?m:[ \t]*$))""", False,
               ("KEY", "SECRET", "TOKEN", "PASSWORD")),
    SecretRule("Slack Token", r"(\b)(xox[abprs]-[A-Za-z0-9-]{10,})()", True, ("xox",)),
]
MASK = "****"
MAX_REPORT_FINDINGS = 10


def secret_types(content: Column, rules: list[SecretRule] = RULES) -> Column:
    """Names of the rules that match, in rule order."""
    # array_remove is generated code; array_compact is not and would interpret all rules below it.
    return F.array_remove(F.array(*[F.when(_matches(content, r), r.name).otherwise("") for r in rules]), "")


def _matches(content: Column, rule: SecretRule) -> Column:
    return contains_any(F.lower(content) if rule.any_case else content, rule.hints) & content.rlike(rule.pattern)


#: Separates the parts of a text around its secrets; a text's own such characters read as blanks meanwhile.
_CUT = "\x02"
_SPAN = "struct<start:int,end:int>"


def _spans(content: Column, rule: SecretRule) -> Column:
    """Where the secrets of one rule lie: the odd parts of the text cut before and after each of them."""
    cut = F.regexp_replace(F.translate(content, _CUT, " "), rule.pattern, f"$1{_CUT}$2{_CUT}$3")
    lengths = F.transform(F.split(cut, _CUT, -1), F.length)
    none = F.struct(F.lit(0).alias("at"), F.lit(False).alias("secret"), F.array().cast(f"array<{_SPAN}>").alias("spans"))
    found = F.aggregate(lengths, none, lambda acc, n: F.struct(
        (acc.at + n).alias("at"), (~acc.secret).alias("secret"),
        F.when(acc.secret, F.concat(acc.spans, F.array(F.struct(acc.at.alias("start"), (acc.at + n).alias("end"))))).otherwise(acc.spans).alias("spans")))
    return F.when(_matches(content, rule), found.spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def secret_spans(content: Column, rules: list[SecretRule] = RULES) -> Column:
    """The secrets of all rules as spans of the text (code points from 0, end exclusive), in order; overlapping ones are one.

    Every rule is matched on the text as it is, so the order of rules does not matter, nor what another one has found.
    """
    ordered = F.sort_array(F.flatten(F.array(*[_spans(content, r) for r in rules])))

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last.start.alias("start"), F.greatest(last.end, s.end).alias("end"))
        return F.when(F.size(acc) == 0, F.array(s)).when(s.start < last.end, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))) \
            .otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, F.array().cast(f"array<{_SPAN}>"), merge)


def mask_text(content: Column, rules: list[SecretRule] = RULES) -> Column:
    """The text with every secret span replaced once."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    kept = F.aggregate(secret_spans(content, rules), start, lambda acc, s: F.struct(
        s.end.alias("at"), F.concat(acc.parts, F.array(F.substring(content, acc.at + 1, s.start - acc.at))).alias("parts")))
    whole = F.transform(F.array(kept), lambda k: F.concat(F.array_join(k.parts, MASK), F.when(F.size(k.parts) > 0, MASK).otherwise(""),
                                                          F.substring(content, k.at + 1, F.length(content))))
    return F.get(whole, F.lit(0))


def scan_secrets(files: DataFrame, rules: list[SecretRule] = RULES) -> DataFrame:
    """One row per file with findings: repo_id, file, secret_types. Narrow."""
    types = F.col("secret_types") if "secret_types" in files.columns else secret_types(F.col("content"), rules)
    found = files.select("repo_id", F.col("path").alias("file"), types.alias("t"))
    # A generator instead of a filter: a filter on computed types is pushed below the projection
    # and computes them twice for every file.
    return found.select("repo_id", "file", F.explode(F.when(F.size("t") > 0, F.array("t"))).alias("secret_types"))


def mask_secrets(df: DataFrame, col: str, rules: list[SecretRule] = RULES) -> DataFrame:
    """Adds ``masked`` and ``secret_types`` for a text column."""
    return df.withColumn("secret_types", secret_types(F.col(col), rules)) \
        .withColumn("masked", F.when(F.size("secret_types") > 0, mask_text(F.col(col), rules)).otherwise(F.col(col)))


def high_risk_files(findings: DataFrame, rules: list[SecretRule] = RULES) -> DataFrame:
    """Files with any high-risk type, in long form: their number per repository has no bound."""
    names = F.array(*[F.lit(r.name) for r in rules if r.high_risk])
    return findings.filter(F.arrays_overlap("secret_types", names)).select("repo_id", "file")


def secrets_report(findings: DataFrame, files: DataFrame, rules: list[SecretRule] = RULES,
                   max_findings: int = MAX_REPORT_FINDINGS) -> DataFrame:
    """Per repository: files scanned, files with secrets, distinct types, number of high-risk
    files, and the first findings. Lists are bounded by the rules and by ``max_findings``;
    the complete list of high-risk files is ``high_risk_files``.
    """
    order = {r.name: i for i, r in enumerate(rules)}
    high = F.array(*[F.lit(r.name) for r in rules if r.high_risk])
    scanned = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files_scanned"))
    # One boolean per rule instead of collected lists: plain partial aggregates.
    flags = [F.max(F.array_contains("secret_types", name)).alias(f"_t{i}") for name, i in order.items()]
    counts = findings.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files_with_secrets"),
        F.count_if(F.arrays_overlap("secret_types", high)).alias("high_risk_count"), *flags)
    types = F.array_compact(F.array(*[F.when(F.col(f"_t{i}"), F.lit(name)) for name, i in order.items()]))
    counts = counts.select("repo_id", "files_with_secrets", "high_risk_count", types.alias("secret_types_found"))
    first = top_n(findings, ["repo_id"], [F.col("file")], max_findings).groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("file", "secret_types"))).alias("findings"))
    empty = F.array().cast("array<string>")
    return scanned.join(counts, "repo_id", "left").join(first, "repo_id", "left").select(
        "repo_id", "total_files_scanned",
        F.coalesce("files_with_secrets", F.lit(0)).alias("files_with_secrets"),
        F.coalesce("secret_types_found", empty).alias("secret_types_found"),
        F.coalesce("high_risk_count", F.lit(0)).alias("high_risk_count"),
        F.coalesce("findings", F.array().cast("array<struct<file:string,secret_types:array<string>>>")).alias("findings"))
