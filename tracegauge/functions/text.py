"""Column functions on text and JSON: canonical form, digests, redaction, rendering."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import beside

# What a redaction writes, and the patterns and key names it acts on.
REDACTED = "[REDACTED]"
BEARER = r"\bbearer\s+[A-Za-z0-9._\-+/=]+"
VENDOR_KEY = r"\b(?:sk|pk|rk|ts|AIza|ghp|gho|xox[abps])[-_A-Za-z0-9]{12,}\b"
LONG_OPAQUE = r"\b(?![0-9a-f]{64}(?![A-Za-z0-9_])(?!-+[A-Za-z0-9_]))[A-Za-z0-9_\-]{32,}\b"
SENSITIVE_KEYS = (
    "authorization",
    "proxy-authorization",
    "x-api-key",
    "api-key",
    "apikey",
    "api_key",
    "access_token",
    "secret",
    "password",
    "token",
    "bearer",
)
STRUCTURAL_KEYS = (
    "trace_id",
    "run_id",
    "model_id",
    "provider",
    "split",
    "template_family",
    "domain",
    "dataset_path",
    "predictions_path",
    "attempts_path",
    "truncation_path",
    "prices_path",
    "git_commit",
)
MIN_SECRET_CHARS = 8
# Token shapes of the text features.
WORD = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def canonical_json(text: Column) -> Column:
    """Sorted keys, compact, non-ASCII kept. An integral float prints without its point."""
    return F.to_json(F.parse_json(text))


def json_string(text: Column) -> Column:
    """A JSON string literal for a text, NULL for NULL; most texts need no escape."""
    quoted = F.to_json(F.array(text))
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(~text.rlike(r'["\\\x00-\x1f]'), F.concat(F.lit('"'), text, F.lit('"')))
        .otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    )


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def content_id(text: Column, seed: int) -> Column:
    """First 16 hex of the digest of canonical content and seed."""
    return F.substring(F.sha2(F.concat_ws(":", text, F.lit(str(seed))), 256), 1, 16)


def trace_id_of(corpus: str, *parts: Column) -> Column:
    return F.concat_ws("/", F.lit(corpus), *parts)


def scenario_of(task_id: Column) -> Column:
    """A task id without its last ``_variation``."""
    return F.regexp_replace(task_id, "_[^_]*$", "")


def table_fingerprint(table: DataFrame, buckets: int = 4096) -> DataFrame:
    """An order-free digest of a table's rows.

    Row digests are summed per bucket in four exact integer lanes, so no bucket is held
    as a list whatever its size, and the bucket digests are joined once more.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    lanes = [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(4)]
    digests = table.select(
        (F.conv(F.substring(row, 57, 8), 16, 10).cast("bigint") % buckets).alias("bucket"),
        *[lane.alias(f"l{i}") for i, lane in enumerate(lanes)],
    )
    folded = digests.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(4)]
    )
    line = F.concat_ws(":", "bucket", "n", *[F.col(f"l{i}").cast("string") for i in range(4)])
    # At most ``buckets`` short lines meet here.
    return folded.agg(
        F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(line))), 256).alias("fingerprint"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
    )


# -- redaction ---------------------------------------------------------------------


def secret_table(spark: SparkSession, values: Sequence[str]) -> DataFrame:
    """Live secrets as a one-row table, so they never stand in a plan as literals."""
    usable = [v for v in values if len(v) >= MIN_SECRET_CHARS]
    return spark.createDataFrame([(usable,)], "secrets array<string>")


def with_secrets(rows: DataFrame, secrets: DataFrame) -> DataFrame:
    return beside(rows, secrets)


def scrub_values(text: Column, secrets: Column | None) -> Column:
    if secrets is None:
        return text
    return F.aggregate(secrets, text, lambda acc, s: F.replace(acc, s, F.lit(REDACTED)))


def redact_text(text: Column, secrets: Column | None = None) -> Column:
    """Live values, bearer tokens, vendor keys, long opaque words; digests survive."""
    out = scrub_values(text, secrets)
    out = F.regexp_replace(out, "(?iU)" + BEARER, "Bearer " + re.escape(REDACTED))
    out = F.regexp_replace(out, "(?U)" + VENDOR_KEY, re.escape(REDACTED))
    return F.regexp_replace(out, "(?U)" + LONG_OPAQUE, re.escape(REDACTED))


def redact_columns(rows: DataFrame, secrets: Column | None = None) -> DataFrame:
    """Column-wise policy: structural names only lose live values, sensitive ones go whole."""

    def policy(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, T.StringType):
            return c
        name = field.name.strip().lower()
        if name in SENSITIVE_KEYS:
            return F.lit(REDACTED).alias(field.name)
        if name in STRUCTURAL_KEYS:
            return scrub_values(c, secrets).alias(field.name)
        return redact_text(c, secrets).alias(field.name)

    return rows.select(*[policy(f) for f in rows.schema.fields])


_JSON_TOKEN = re.compile(r'\n|("(?:[^"\\]++|\\.)*+")(:?)|[{}\[\],]|[^\s"{}\[\],:]+')
_MARKS = tuple((re.compile(p, f), m) for p, f, m in ((BEARER, re.I, f"Bearer {REDACTED}"), (VENDOR_KEY, 0, REDACTED), (LONG_OPAQUE, 0, REDACTED)))
_SENSITIVE, _STRUCTURAL = frozenset(SENSITIVE_KEYS), frozenset(STRUCTURAL_KEYS)


class _Redactor:
    """Rewrites canonical JSON texts, one per line, token by token.

    ``policy`` holds one letter per open container: s lets only live values go, d drops
    what is inside, p applies every pattern. ``coming`` is the policy a key set for its value.
    """

    def __init__(self, secrets: Sequence[Sequence[str]]):
        self.secrets = iter(secrets)
        self.new_line()

    def new_line(self) -> str:
        self.live, self.policy, self.coming = next(self.secrets, ()), ["p"], ""
        return "\n"

    def value(self, quoted: str) -> str:
        text = json.loads(quoted)
        for live in self.live:
            text = text.replace(live, REDACTED)
        for pattern, mark in _MARKS if (self.coming or self.policy[-1]) == "p" else ():
            text = pattern.sub(mark, text)
        return json.dumps(text, ensure_ascii=False)

    def __call__(self, match: re.Match) -> str:
        token, quoted, colon = match.group(0), match.group(1), match.group(2)
        if token == "\n":
            return self.new_line()
        here = self.policy[-1]
        if token in "}]":
            self.policy.pop()
            return "" if here == "d" else token
        if colon:
            name = json.loads(quoted).strip().lower()
            self.coming = "d" if name in _SENSITIVE else "s" if name in _STRUCTURAL else here
            return "" if here == "d" else token
        if token == ",":
            self.coming = ""
            return "" if here == "d" else token
        mode = self.coming or here
        out = "" if here == "d" else json.dumps(REDACTED) if mode == "d" else self.value(quoted) if quoted else token
        if token in "{[":
            self.policy.append(mode)
        self.coming = ""
        return out


@F.pandas_udf(T.StringType())
def _redact_lines(body: pd.Series, secrets: pd.Series) -> pd.Series:
    """One pass over the texts of a whole Arrow batch; canonical JSON holds no raw line break."""
    done = _JSON_TOKEN.sub(_Redactor(list(secrets)), "\n".join(body.fillna("null")))
    return pd.Series(done.split("\n"), index=body.index).where(body.notna(), None)


def redact_json(body: Column, secrets: Column) -> Column:
    """Redaction inside free-form JSON, where the key names are only known per row; canonical JSON comes out."""
    return _redact_lines(canonical_json(body), secrets)


def contains_secret(text: Column, secrets: Column) -> Column:
    return F.exists(secrets, lambda s: F.contains(text, s))


# -- rendering -----------------------------------------------------------------------


def none_or(text: Column) -> Column:
    return F.coalesce(text, F.lit("None"))


def json_or_null(text: Column) -> Column:
    return F.coalesce(canonical_json(text), F.lit("null"))


def render_features(goal: Column, tools: Column, events: Column) -> Column:
    """The text a classifier reads: goal, tools, then one line per event."""

    def line(e: Column) -> Column:
        call = F.concat(F.lit("call "), none_or(e["tool"]), F.lit(" args "), json_or_null(e["arguments"]))
        result = F.concat(
            F.lit("result "), none_or(e["tool"]), F.lit(" status "), none_or(e["status"]), F.lit(" data "), json_or_null(e["data"])
        )
        return F.when(e["type"] == "assistant_tool_call", call).when(e["type"] == "tool_result", result).otherwise(
            F.concat(F.lit("assistant "), none_or(e["text"]))
        )

    head = F.array(F.concat(F.lit("goal: "), goal), F.concat(F.lit("tools: "), F.concat_ws(" ", F.transform(tools, lambda t: t["name"]))))
    return F.concat_ws("\n", F.concat(head, F.transform(events, line)))


def render_trace(goal: Column, events: Column) -> Column:
    """One line per trace for a reviewer's sheet."""

    def part(e: Column) -> Column:
        call = F.concat(F.lit("CALL "), none_or(e["tool"]), F.lit("("), json_or_null(e["arguments"]), F.lit(")"))
        result = F.concat(
            F.lit("RESULT "), none_or(e["tool"]), F.lit(" status="), none_or(e["status"]), F.lit(" data="), json_or_null(e["data"])
        )
        return F.when(e["type"] == "assistant_tool_call", call).when(e["type"] == "tool_result", result).otherwise(
            F.concat(F.lit("ASSISTANT: "), none_or(e["text"]))
        )

    return F.concat_ws(" | ", F.concat(F.array(F.concat(F.lit("GOAL: "), goal)), F.transform(events, part)))


def final_assistant_text(events: Column) -> Column:
    """The last non-empty assistant message in array order, else an empty text."""
    said = F.filter(
        events, lambda e: (e["type"] == "assistant_message") & (F.coalesce(F.length(e["text"]), F.lit(0)) > 0)
    )
    return F.coalesce(F.try_element_at(said, F.lit(-1))["text"], F.lit(""))
