"""Personal-data queries (I1-I9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.base import Entry, columns_of, listed, over, table, view
from catalogue.profiling import LINE_NUMBERS, _numeric_facts, union
from tablewise.functions.columns import wide_to_long
from tablewise.functions.masking import scrub_text
from tablewise.functions.patterns import PATTERNS, matches
from tablewise.operators import pii
from tablewise.plans import card

ENTRIES: dict[str, Entry] = {}
PEOPLE = "personal_customers"


def add(name: str, source: str, body: str | None, run) -> None:
    ENTRIES[name] = Entry(
        lambda spark, sf: run(view(spark, sf, source)), over(source, body) if body else None
    )


# The SQL twin's regular expressions have no look-around: neighbours are matched
# outright, which is the same for the question whether there is a match.
_EDGE = {c: p.replace(r"(?<!\d)", "(^|[^0-9])").replace(r"(?!\d)", "([^0-9]|$)")
         for c, p in PATTERNS.items()}
# Its \b knows ASCII letters only; the tables hold accented ones too.
_WORDY = {
    c: p.replace(r"\b", r"(^|[^\p{L}\p{N}_])", 1).replace(r"\b", r"([^\p{L}\p{N}_]|$)")
    for c, p in _EDGE.items()
}


def _hits(column: str, category: str, patterns: dict[str, str]) -> str:
    text = patterns[category].replace("'", "''")
    return f"count(*) FILTER (WHERE regexp_matches(CAST({column} AS STRING), '{text}'))"


# Headers of the view and the hint each one gives.
_HINTS = {
    "customer_email": "email", "phone_no": "mobile", "aadhaar_no": "aadhaar", "pan_no": "pan",
    "card_no": "credit_card", "pincode": "pincode", "ifsc_code": "ifsc", "gst_no": "gstin",
    "full_name": "name", "street": "address",
}


def _detect_sql() -> str:
    rows = []
    for i, c in enumerate(columns_of(PEOPLE)):
        found = [
            f"CASE WHEN {_hits(c, k, _EDGE)} >= {0.5 if k == 'pincode' else 0.2} * count({c}) "
            f"AND '{k}' <> '{_HINTS.get(c, '')}' THEN '{k}' END"
            for k in PATTERNS
        ]
        hint = f"'{_HINTS[c]}'" if c in _HINTS else "NULL"
        rows.append(
            f"SELECT '{c}' AS \"column\", concat_ws(',', {hint}, {', '.join(found)}) AS categories FROM d"
        )
    return union(rows)


add(
    "i03_detect", PEOPLE, f"SELECT * FROM ({_detect_sql()}) WHERE categories <> ''",
    lambda df: pii.detect_pii(df).select(
        "column", F.array_join("categories", ",").alias("categories")
    ),
)
ENTRIES["i03_hits_documents"] = Entry(
    lambda spark, sf: table(spark, sf, "documents").agg(
        *[F.count_if(matches(F.col("text"), k)).alias(k) for k in PATTERNS]
    ),
    "SELECT " + ", ".join(f"{_hits('text', k, _WORDY)} AS {k}" for k in PATTERNS)
    + " FROM documents",
)
ENTRIES["i03_detect_orders"] = Entry(
    lambda spark, sf: pii.detect_pii(table(spark, sf, "orders")).select(
        "column", F.array_join("categories", ",").alias("categories")
    ),
    "SELECT * FROM (" + union([
        f"SELECT '{c}' AS \"column\", concat_ws(',', " + ", ".join(
            f"CASE WHEN {_hits(c, k, _EDGE)} >= {0.5 if k == 'pincode' else 0.2} * count({c}) "
            f"THEN '{k}' END" for k in PATTERNS
        ) + ") AS categories FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                  "o_orderpriority")
    ]) + ") WHERE categories <> ''",
)
add(
    "i04_summary", PEOPLE,
    f", f AS ({_detect_sql()}), u AS (SELECT unnest(string_split(categories, ',')) AS category "
    "FROM f WHERE categories <> '') SELECT category, count(*) AS n_columns FROM u GROUP BY category "
    "UNION ALL SELECT '(any)', count(*) FROM f WHERE categories <> ''",
    pii.pii_summary,
)

# ------------------------------------------------------------------ I5 hashing

_PLAN = {c: [k] for c, k in _HINTS.items()} | {"c_custkey": ["uid"], "note": []}
_SALT = "a salt"


def _replaced(exprs: dict[str, str]) -> str:
    return f"SELECT {listed(PEOPLE, exprs)} FROM d"


add(
    "i05_hash", PEOPLE,
    _replaced({
        c: f"substr(sha256(concat('{_SALT}:', CAST(nullif(CAST({c} AS STRING), NULL) AS STRING))), 1, 10)"
        if c != "customer_email" else
        f"CASE WHEN {c} IS NOT NULL THEN substr(sha256(concat('{_SALT}:', {c})), 1, 10) END"
        for c, k in _PLAN.items() if k
    }),
    lambda df: pii.mask_pii(df, _PLAN, "hash", salt=_SALT),
)

# ---------------------------------------------------------------- I6 redaction

_STAR = "repeat('*', length({c}))"
_DIG = "regexp_replace({c}, '[^0-9]', '', 'g')"
_REDACT = {
    "email": "CASE WHEN {c} IS NULL THEN NULL WHEN instr({c}, '@') = 0 THEN '***' ELSE concat("
    "CASE WHEN instr({c}, '@') > 2 THEN concat(substr({c}, 1, 1), '***') ELSE '***' END, "
    "substr({c}, instr({c}, '@'))) END",
    "mobile": "CASE WHEN length({d}) >= 10 THEN concat(substr(right({d}, 10), 1, 2), '******', "
    "right({d}, 2)) ELSE {s} END",
    "aadhaar": "CASE WHEN length({d}) = 12 THEN concat('XXXX-XXXX-', right({d}, 4)) ELSE {s} END",
    "pan": "CASE WHEN length({c}) = 10 THEN concat(substr({c}, 1, 5), '****', right({c}, 1)) "
    "ELSE {s} END",
    "credit_card": "CASE WHEN length({d}) >= 13 THEN concat(repeat('*', length({d}) - 4), "
    "right({d}, 4)) ELSE {s} END",
    "pincode": "CASE WHEN length({d}) = 6 THEN concat(substr({d}, 1, 2), '****') ELSE {s} END",
    "ifsc": "CASE WHEN length({c}) = 11 THEN concat(substr({c}, 1, 4), '0******') ELSE {s} END",
    "gstin": "CASE WHEN length({c}) = 15 THEN concat(substr({c}, 1, 2), '*****', "
    "substr({c}, 8, 4), '***') ELSE {s} END",
    "name": "CASE WHEN trim({c}) = '' THEN '***' ELSE array_to_string(list_transform(string_split_regex("
    "trim({c}), '\\s+'), lambda w: concat(w[1], '***')), ' ') END",
    "address": "CASE WHEN length({c}) <= 4 THEN {s} ELSE concat(substr({c}, 1, 3), "
    "repeat('*', length({c}) - 3)) END",
    "other": "CASE WHEN length({c}) <= 2 THEN {s} ELSE concat(substr({c}, 1, 1), "
    "repeat('*', length({c}) - 2), right({c}, 1)) END",
}


def _redacted(column: str, category: str) -> str:
    return _REDACT[category].format(
        c=column, d=_DIG.format(c=column), s=_STAR.format(c=column)
    )


for _column, _category in [*_HINTS.items(), ("note", "other")]:
    add(
        f"i06_redact_{_category}", PEOPLE,
        f"SELECT c_custkey, {_redacted(_column, _category)} AS {_column} FROM d",
        lambda df, c=_column, k=_category: pii.mask_pii(
            df.select("c_custkey", c), {c: [k]}, "redact"
        ),
    )

# ---------------------------------------------------------------- I7 synthetic

_MATCHED = {c: k for c, k in _HINTS.items() if k in PATTERNS}


def _synthetic_check(df):
    """Fakes keep gaps, match their own matcher, differ from the input, and repeat."""
    def named(frame, prefix):
        return frame.select(
            F.col("note").alias(f"{prefix}_note"),
            *[F.col(c).alias(f"{prefix}_{k}") for c, k in _MATCHED.items()],
        )

    fake = named(pii.mask_pii(df, _PLAN, "synthetic", seed=7), "f")
    again = named(pii.mask_pii(df.repartition(5), _PLAN, "synthetic", seed=7), "g")
    # Both sides have every row, so they meet by a shuffle: neither goes through the driver.
    both = fake.join(again.hint("merge"), F.col("f_note") == F.col("g_note")).join(
        named(df, "v").hint("merge"), F.col("f_note") == F.col("v_note")
    )
    found = both.agg(
        *[
            measure.alias(f"{k}_{i}")
            for k in _MATCHED.values()
            for i, measure in enumerate((
                F.count(f"f_{k}"),
                F.count_if(matches(F.col(f"f_{k}"), k)),
                F.count_if(F.col(f"f_{k}") == F.col(f"g_{k}")),
                F.count_if(F.col(f"f_{k}") == F.col(f"v_{k}")),
            ))
        ]
    )
    measured = [(F.lit(k), *[F.col(f"{k}_{i}") for i in range(4)]) for k in _MATCHED.values()]
    out = found.select(
        wide_to_long(measured, ["category", "present", "matching", "repeated", "leaked"])
    ).drop("i")
    # A six-digit code space can hit its own input by chance: allow a trace there.
    return out.withColumn("leaked", F.col("leaked") > F.col("present") * 0.001)


add(
    "i07_synthetic_checks", PEOPLE,
    union([
        f"SELECT '{k}' AS category, count({c}) AS present, count({c}) AS matching, "
        f"count({c}) AS repeated, FALSE AS leaked FROM d" for c, k in _MATCHED.items()
    ]),
    _synthetic_check,
)
add("i07_synthetic", PEOPLE, None, lambda df: pii.mask_pii(df, _PLAN, "synthetic"))

# ------------------------------------------------------------------- I8 scrub

# Twin for replacements: neighbours are captured and put back.  A neighbour shared by
# two matches is consumed by the first, so every step runs twice.


def _scrub_sql(column: str) -> str:
    marks = {
        "mobile": "<PHONE>", "aadhaar": "<AADHAAR>", "pan": "<PAN>", "email": "<EMAIL>",
        "credit_card": "<CARD>", "pincode": "<PINCODE>", "ifsc": "<IFSC>", "gstin": "<GSTIN>",
    }
    out = column
    for k, p in _WORDY.items():
        inner = p.replace("(?:", "(?:")
        groups = inner.count("(") - inner.count("(?:") - inner.count("\\(")
        text = inner.replace("'", "''")
        for _ in range(2):
            out = f"regexp_replace({out}, '{text}', '\\1{marks[k]}\\{groups}', 'g')"
    return out


ENTRIES["i08_scrub_documents"] = Entry(
    lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id", scrub_text(F.col("text")).alias("text")
    ),
    f"SELECT doc_id, {_scrub_sql('text')} AS text FROM documents",
)
add(
    "i08_scrub_columns", PEOPLE, None,
    lambda df: pii.scrub_columns(df, {c: [k] for c, k in _HINTS.items()}),
)
add(
    "i08_scrub_whole_cells", PEOPLE,
    "SELECT c_custkey, CASE WHEN full_name IS NULL THEN NULL ELSE '<NAME>' END AS full_name, "
    "'<ADDRESS>' AS street, CASE WHEN length(pan_no) = 10 THEN '<PAN>' ELSE pan_no END AS pan_no FROM d",
    lambda df: pii.scrub_columns(
        df.select("c_custkey", "full_name", "street", "pan_no"),
        {"full_name": ["name"], "street": ["address"], "pan_no": ["pan"]},
        keep=["c_custkey"],
    ),
)

# -------------------------------------------------------------------- I9 card

add(
    "i09_card_schema", PEOPLE,
    "SELECT 'schema' AS section, i AS ordinal, printf('| %s | %s | %.1f%% |', c, t, p) AS text FROM ("
    + union([
        f"SELECT CAST({i} AS INT) AS i, '{c}' AS c, "
        f"'{'bigint' if c == 'c_custkey' else 'string'}' AS t, "
        f"100.0 * count({c}) / count(*) AS p FROM d" for i, c in enumerate(columns_of(PEOPLE))
    ]) + ")",
    card.schema_lines,
)
add(
    "i09_card_sections", PEOPLE, None,
    lambda df: card.card_sections(df, plan={c: [k] for c, k in _HINTS.items()},
                                  order_by=["c_custkey"]),
)
_NUMERIC = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
_SHOWN = " || ' | ' || ".join(f"CAST({c} AS VARCHAR)" for c in _NUMERIC)
_PLACES = " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(columns_of("dirty_lines")))
ENTRIES["i09_card_numeric"] = Entry(
    lambda spark, sf: card.numeric_lines(view(spark, sf, "dirty_lines")),
    over("dirty_lines", "").rstrip() + f", f AS ({_numeric_facts(LINE_NUMBERS)}), g AS (SELECT "
    "\"column\", n AS count, round(mean, 2) AS mean, round(sds, 2) AS std, round(lo, 2) AS min, "
    "round(q25, 2) AS q25, round(q50, 2) AS q50, round(q75, 2) AS q75, round(hi, 2) AS max FROM f) "
    f"SELECT 'numeric' AS section, CAST(CASE \"column\" {_PLACES} END AS INT) AS ordinal, "
    f"'| ' || \"column\" || ' | ' || {_SHOWN} || ' |' AS text FROM g",
)
_LINE_PAIRS = [
    (i, j, a, b)
    for i, a in enumerate(LINE_NUMBERS) for j, b in enumerate(LINE_NUMBERS) if i < j
]
ENTRIES["i09_card_correlations"] = Entry(
    lambda spark, sf: card.correlation_lines(view(spark, sf, "dirty_lines")),
    over("dirty_lines", "").rstrip() + ", r AS (" + union([
        f"SELECT {i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, "
        f"(SELECT CASE WHEN isfinite(corr({a}, {b})) THEN corr({a}, {b}) END FROM d) AS r"
        for i, j, a, b in _LINE_PAIRS
    ]) + ") SELECT 'correlations' AS section, CAST(i * 10000 + j AS INT) AS ordinal, "
    "printf('| %s | %s | %.2f |', a, b, abs(r)) AS text FROM r WHERE r IS NOT NULL "
    "ORDER BY abs(r) DESC, i, j LIMIT 5",
)
add(
    "i09_card_sample", PEOPLE,
    "SELECT 'sample' AS section, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS INT) AS ordinal, "
    "'| ' || CAST(c_custkey AS VARCHAR) || ' | <NAME> | <ADDRESS> | ' || note || ' |' AS text FROM d "
    "WHERE full_name IS NOT NULL ORDER BY c_custkey LIMIT 4",
    lambda df: card.sample_lines(
        df.where("full_name IS NOT NULL").select("c_custkey", "full_name", "street", "note"), 4,
        {"full_name": ["name"], "street": ["address"]}, ["c_custkey"],
    ),
)
add(
    "i08_scrub_columns_marked", PEOPLE,
    "SELECT c_custkey, CASE WHEN customer_email IS NULL THEN NULL WHEN customer_email = 'none' THEN 'none' "
    "ELSE '<EMAIL>' END AS customer_email, CASE WHEN phone_no = 'n/a' THEN 'n/a' ELSE '<PHONE>' END "
    "AS phone_no, CASE WHEN pan_no = 'ABC' THEN 'ABC' ELSE '<PAN>' END AS pan_no, '<IFSC>' AS ifsc_code "
    "FROM d",
    lambda df: pii.scrub_columns(
        df.select("c_custkey", "customer_email", "phone_no", "pan_no", "ifsc_code"),
        {c: [_HINTS[c]] for c in ("customer_email", "phone_no", "pan_no", "ifsc_code")},
        keep=["c_custkey"],
    ),
)
