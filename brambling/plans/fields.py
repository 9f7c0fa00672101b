"""Functions on fields: every query builds its texts and numbers from the order tables and has an SQL twin that knows the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.functions import checks, numbers, text
from brambling.operators import documents, extraction, joins, policies, scoring
from brambling.plans.registry import Registry
from brambling.sources.tables import spread, table

Q = Registry()

#: Orders with their price in hundredths, and its whole and broken part.
MONEY = "SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS whole, CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS frac, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS day FROM orders"


def money(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), cents.alias("cents"), F.floor(cents / 100).alias("whole"), (cents % 100).alias("frac"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("day"),
    )


def put(*parts: Column | str | int) -> Column:
    """Column names in braces and plain texts, put together."""
    made = []
    for p in parts:
        made.append(p.cast("string") if isinstance(p, Column) else F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p))
    return F.concat(*made)


def pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def by_case(n: Column, *values: Column) -> Column:
    """The value of the case number ``n``, the last one for all others."""
    out = values[-1]
    for i in range(len(values) - 2, -1, -1):
        out = F.when(n == i, values[i]).otherwise(out)
    return out


@Q.query("""
WITH t AS (SELECT c_custkey, c_name, 'ŞIRKET  Iğdır Çöküş ' || c_name || chr(9) || ' ' AS t FROM customer)
SELECT c_custkey, translate(t, 'İıĞğÜüŞşÖöÇç', 'IiGgUuSsOoCc') AS folded, lower(translate(t, 'Iİ', 'ıi')) AS lowered, trim(regexp_replace(lower(translate(t, 'Iİ', 'ıi')), '\\s+', ' ', 'g')) AS label,
  lower(regexp_replace(trim(' ' || c_name || ' no 1 '), '\\s+', '', 'g')) AS identifier, '' AS absent FROM t""")
def folded_names(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("ŞIRKET  Iğdır Çöküş "), F.col("c_name"), F.lit("\t "))
    return table(spark, d, "customer").select(
        "c_custkey", text.fold_ascii(t).alias("folded"), text.lower_turkish(t).alias("lowered"), text.label_key(t).alias("label"),
        text.identifier_key(F.concat(F.lit(" "), F.col("c_name"), F.lit(" no 1 "))).alias("identifier"), text.identifier_key(F.lit(None).cast("string")).alias("absent"),
    )


OCR_SQL = "regexp_replace(translate(lower({0}), '01lıi5', 'oiiiis'), '[^a-z0-9]', '', 'g')"
ALIKE_SQL = "(NOT (({a} = '') <> ({b} = '')) AND ({x} = {y} OR CASE WHEN {x} = '' AND {y} = '' THEN 1.0 WHEN {x} = '' OR {y} = '' THEN 0.0 ELSE 1 - levenshtein({x}, {y})::DOUBLE / greatest(length({x}), length({y})) END >= CASE WHEN least(length({x}), length({y})) < 5 THEN 0.9 ELSE {t} END))"


def alike_sql(a: str, b: str, least: float) -> str:
    return ALIKE_SQL.format(a=a, b=b, x=OCR_SQL.format(a), y=OCR_SQL.format(b), t=least)


@Q.query(f"""
WITH t AS (SELECT c_custkey, c_name AS a, CASE c_custkey % 5 WHEN 0 THEN replace(c_name, '0', 'o') WHEN 1 THEN c_name || 'xyz' WHEN 2 THEN '' WHEN 3 THEN upper(c_name) ELSE 'Kunde ' || c_custkey END AS b FROM customer)
SELECT c_custkey, {alike_sql("a", "b", 0.85)} AS alike, {alike_sql("b", "b", 0.85)} AS itself FROM t""")
def ocr_alike_names(spark: SparkSession, d: str) -> DataFrame:
    a, n = F.col("c_name"), F.col("c_custkey") % 5
    b = by_case(n, F.replace(a, F.lit("0"), F.lit("o")), F.concat(a, F.lit("xyz")), F.lit(""), F.upper(a), F.concat(F.lit("Kunde "), F.col("c_custkey").cast("string")))
    return table(spark, d, "customer").select("c_custkey", text.ocr_alike(a, b).alias("alike"), text.ocr_alike(b, b).alias("itself"))


@Q.query(f"""
SELECT k, CASE k % 6 WHEN 4 THEN whole / 1000.0 WHEN 5 THEN NULL ELSE cents / 100.0 END AS number, CASE WHEN k % 6 < 4 AND cents / 100.0 <= 100000 THEN cents / 100.0 WHEN k % 6 = 4 THEN whole / 1000.0 END AS bounded,
  CASE k % 6 WHEN 3 THEN whole // 1000 + ((whole % 1000) * 100 + frac) / 100000.0 WHEN 4 THEN CAST(whole AS DOUBLE) WHEN 5 THEN 0.0 ELSE cents / 100.0 END AS amount,
  replace(format('{{:,}}', whole), ',', '.') || ',' || lpad(CAST(frac AS VARCHAR), 2, '0') AS shown FROM ({MONEY})""")
def parsed_money(spark: SparkSession, d: str) -> DataFrame:
    whole, frac = F.col("whole"), pad(F.col("frac"), 2)
    high, low = F.floor(whole / 1000).cast("string"), pad(whole % 1000, 3)
    written = by_case(F.col("k") % 6, put("{whole}", ",", frac, " TL"), put("{whole}", ".", frac), put(high, ".", low, ",", frac), put("TRY ", high, ",", low, ".", frac), put(high, ".", low, " TL"), F.lit("none"))
    rows = money(spark, d).withColumn("t", written)
    return rows.select("k", numbers.parse_number("t").alias("number"), numbers.parse_number("t", 0, 100_000).alias("bounded"), numbers.parse_amount("t").alias("amount"), numbers.format_turkish(F.col("cents") / 100).alias("shown"))


@Q.query(f"""
SELECT k, CASE WHEN k % 7 < 5 THEN day END AS parsed, CAST(CASE WHEN k % 2 = 0 THEN [day, CAST(day + INTERVAL 40 DAY AS DATE)] ELSE [day] END AS VARCHAR) AS dates,
  CASE WHEN day < DATE '1997-01-01' THEN 'expired' WHEN day <= DATE '1997-01-31' THEN 'expiring' ELSE 'active' END AS status FROM ({MONEY})""")
def parsed_days(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("day")
    fmt = lambda p, c=day: F.date_format(c, p)
    names = F.array(*[F.lit(m) for m in numbers.MONTHS])
    month = F.element_at(names, F.month("day"))
    written = by_case(F.col("k") % 7, fmt("dd.MM.yyyy"), fmt("d/M/yy"), fmt("yyyy-MM-dd"), put(fmt("d"), " ", F.initcap(month), " ", fmt("yyyy")), put("on ", fmt("dd-MM-yyyy"), "."), F.lit("31.02.1999"), F.lit("soon"))
    later = F.when(F.col("k") % 2 == 0, put("until ", fmt("yyyy-MM-dd", F.date_add("day", 40)), " or ", fmt("d.M.yyyy"))).otherwise(fmt("dd/MM/yyyy"))
    dates = numbers.all_dates(put("from ", fmt("dd.MM.yyyy"), " ", later))
    rows = spread(money(spark, d))
    return rows.select("k", numbers.parse_date(written).alias("parsed"), F.concat(F.lit("["), F.array_join(F.transform(dates, lambda x: x.cast("string")), ", "), F.lit("]")).alias("dates"), numbers.expiry_status("day", F.lit("1997-01-01").cast("date")).alias("status"))


# Letter values and weights of vehicle numbers.
VIN_SQL = "list_sum(list_transform(range(1, 18), lambda i: [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2][i] * CAST(translate(vin[i], 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789') AS INTEGER))) % 11"
TAX_SQL = "(10 - list_sum(list_transform(range(1, 10), lambda i: CASE WHEN (t[i] + {0} - (i - 1)) % 10 = 0 THEN 0 WHEN ((t[i] + {0} - (i - 1)) % 10 * CAST(2 ** (10 - i) AS INTEGER)) % 9 = 0 THEN 9 ELSE ((t[i] + {0} - (i - 1)) % 10 * CAST(2 ** (10 - i) AS INTEGER)) % 9 END)) % 10) % 10 = t[10]"


@Q.query(f"""
WITH n AS (SELECT o_orderkey AS k, lpad(CAST((o_orderkey * 7919 + 13) % 10000000000 AS VARCHAR), 10, '1') AS tax, 'WVWZZZ1K' || CAST(o_orderkey % 10 AS VARCHAR) || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS vin, lpad(CAST(o_orderkey % 90 AS VARCHAR), 2, '0') || ' ab ' || (o_orderkey % 5000) AS plate,
  lpad(CAST(o_orderkey * 31 % 100 AS VARCHAR), 2, '0') AS c, '00061' || lpad(CAST(o_orderkey AS VARCHAR), 17, '0') AS bban FROM orders), g AS (SELECT *, list_transform(string_split(tax, ''), lambda x: CAST(x AS INTEGER)) AS t FROM n)
SELECT k, {TAX_SQL.format(10)} AS tax, {TAX_SQL.format(9)} AS tax_other, true AS vin, vin[9] = CASE {VIN_SQL} WHEN 10 THEN 'X' ELSE CAST({VIN_SQL} AS VARCHAR) END AS vin_digit, k % 90 BETWEEN 1 AND 81 AND k % 5000 < 10000 AS plate,
  CAST(bban || '2927' || c AS HUGEINT) % 97 = 1 AS iban, '0532 ' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || ' 12 34' AS phone, 100 + k % 3 <= 101 AS premium, k % 4 <> 0 AS pages, k % 130 BETWEEN 0 AND 100 AS share,
  concat_ws(',', CASE WHEN k % 4 = 0 THEN 'pages' END, CASE WHEN k % 130 > 100 THEN 'share' END) AS failed FROM g""")
def identifier_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = k.cast("string")
    vin = F.concat(F.lit("WVWZZZ1K"), (k % 10).cast("string"), pad(k, 8))
    account = F.concat(F.lit("tr"), F.lpad((k * 31 % 100).cast("string"), 2, "0"), F.lit(" 00061 "), pad(k, 17))
    phone = by_case(k % 3, F.concat(F.lit("0532"), pad(k % 1000, 3), F.lit("1234")), F.concat(F.lit("+90 (532) "), pad(k % 1000, 3), F.lit(" 12 34")), F.concat(F.lit("532-"), pad(k % 1000, 3), F.lit("-1234")))
    pages = F.when(k % 4 == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(2), F.lit(1)))
    tax = F.lpad(((k * 7919 + 13) % 10_000_000_000).cast("string"), 10, "1")
    rows = spread(table(spark, d, "orders")).select(k, vin.alias("v"), pages.alias("pages"), (k % 130).alias("share"))
    return rows.select(
        k.alias("k"), checks.tax_number(tax).alias("tax"), checks.tax_number(tax, 9).alias("tax_other"), checks.vehicle_number("v").alias("vin"), checks.vehicle_number_digit("v").alias("vin_digit"),
        checks.plate(F.concat(pad(k % 90, 2), F.lit(" ab "), (k % 5000).cast("string"))).alias("plate"), checks.iban(account).alias("iban"), checks.phone(phone).alias("phone"),
        checks.premium_sum(F.lit(90.0), F.lit(10.0), 100 + (k % 3) + F.lit(0.0)).alias("premium"), checks.page_sequence("pages").alias("pages"), checks.within("share").alias("share"),
        F.array_join(checks.failures([("pages", "page_sequence", ("pages",)), ("share", "percent", ("share",))]), ",").alias("failed"),
    )


BOXES = "SELECT o_orderkey AS k, CAST(o_orderkey % 50 AS DOUBLE) AS ax, CAST(o_orderkey % 30 AS DOUBLE) AS ay, CAST(o_orderkey % 50 + o_orderkey % 13 AS DOUBLE) AS bx, CAST(o_orderkey % 30 + o_orderkey % 7 AS DOUBLE) AS y2 FROM orders"
SHARED = "(20 - o_orderkey % 13) * greatest(0, 10 - o_orderkey % 7)"


@Q.query(f"SELECT o_orderkey AS k, {SHARED} / CAST(400 - {SHARED} AS DOUBLE) AS share FROM orders")
def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    box = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(20.0).alias("width"), F.lit(10.0).alias("height"))
    return table(spark, d, "orders").select(k.alias("k"), numbers.overlap(box(k % 50, k % 30), box(k % 50 + k % 13, k % 30 + k % 7)).alias("share"))


@Q.query(f"""
SELECT k, engine, id, CASE WHEN near THEN 2 * k ELSE id END AS group_id FROM (SELECT o_orderkey AS k, 'a' AS engine, 2 * o_orderkey AS id, {SHARED} / CAST(400 - {SHARED} AS DOUBLE) >= 0.5 AS near FROM orders
UNION ALL SELECT o_orderkey, 'b', 2 * o_orderkey + 1, {SHARED} / CAST(400 - {SHARED} AS DOUBLE) >= 0.5 FROM orders)""")
def aligned_tokens(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    box = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(20.0).alias("width"), F.lit(10.0).alias("height"))
    token = lambda e, i, b: F.struct(F.lit(e).alias("engine"), i.alias("id"), F.lit("w").alias("word"), b.alias("box"))
    both = F.array(token("a", 2 * k, box(k % 50, k % 30)), token("b", 2 * k + 1, box(k % 50 + k % 13, k % 30 + k % 7)))
    rows = table(spark, d, "orders").select(k.alias("k"), F.explode(both).alias("t")).select("k", "t.*")
    return joins.align_boxes(rows, ["k"], "engine", "id", "word", "box").select("k", "engine", "id", "group_id")


@Q.query("""
SELECT p_partkey, exp(p_size / 10.0 + 0.125) AS lognormal, CASE WHEN p_size % 4 > 1 THEN (p_size % 4) * p_retailprice / ((p_size % 4) - 1) END AS pareto,
  CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.8 END * CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.85 END * CASE p_partkey % 2 WHEN 0 THEN 1.0 ELSE 0.9 END AS factor FROM part""")
def loss_means(spark: SparkSession, d: str) -> DataFrame:
    from brambling.operators.losses import quality_factor

    size, key = F.col("p_size"), F.col("p_partkey")
    factor = quality_factor(by_case(size % 3, F.lit("original"), F.lit("equivalent"), F.lit("used")), by_case(key % 3, F.lit("any"), F.lit("contracted"), F.lit("own")), by_case(key % 2, F.lit("concrete"), F.lit("abstract")))
    pareto = numbers.pareto_mean(F.col("p_retailprice"), (size % 4).cast("double"))
    return table(spark, d, "part").select("p_partkey", numbers.lognormal_mean(size / 10, F.lit(0.5)).alias("lognormal"), F.when(pareto != float("inf"), pareto).alias("pareto"), factor.alias("factor"))


@Q.query("""
WITH s AS (SELECT o_orderkey AS k, o_orderkey % 101 AS s, (o_orderkey % 11) / 10.0 AS a, (o_orderkey % 7) / 6.0 AS b FROM orders)
SELECT k, CASE WHEN s >= 90 THEN 'excellent' WHEN s >= 75 THEN 'good' WHEN s >= 60 THEN 'fair' WHEN s >= 40 THEN 'poor' ELSE 'critical' END AS status,
  CAST(least(100, greatest(0, floor(CASE WHEN k % 9 = 0 THEN s + 3 ELSE s * 0.4 + 80 * 0.6 + 3 END + 0.5))) AS DOUBLE) AS value,
  CASE WHEN (a * 0.25 + b * 0.30 + a * 0.15 + b * 0.15 + 1.0 * 0.15) >= 0.7 THEN 'skip' WHEN (a * 0.25 + b * 0.30 + a * 0.15 + b * 0.15 + 1.0 * 0.15) >= 0.4 THEN 'selective' ELSE 'full' END AS decision,
  least(1.0, a * 0.3 + (1 - b) * 0.25 + (1 - a) * 0.2 + (1 - b) * 0.15 + (1 - a) * 0.1) AS errors,
  floor(least(100, greatest(0, 100 * (a * 0.40 + b * 0.25 + (1 - a) * 0.15 + b * 0.10 + 1.0 * 0.10))) * 10 + 0.5) / 10 AS confidence,
  least(CASE WHEN k % 4 = 0 THEN 70 ELSE 100 END, CASE WHEN k % 10 = 0 THEN 40 ELSE 100 END, greatest(0, least(100, CASE WHEN k % 2 = 0 THEN 60 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 40 ELSE 0 END + 5 - 2))) AS qa FROM s""")
def score_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    s, a, b = k % 101, (k % 11) / 10, (k % 7) / 6
    premium = F.when(k % 9 == 0, -1).otherwise(s)
    qa = policies.qa_score({"number": (k % 2 == 0, 60), "dates": (k % 3 == 0, 40)}, F.lit(5), F.lit(2), [(k % 4 != 0, 70), (k % 10 != 0, 40)])
    return table(spark, d, "orders").select(
        k.alias("k"), numbers.score_status(s).alias("status"), policies.value_score(premium, F.when(k % 9 == 0, s).otherwise(80), F.lit(3)).cast("double").alias("value"),
        documents.ocr_decision(a, b, a, b, F.lit(1.0)).alias("decision"), documents.error_rate_estimate(a, b, a, b, a).alias("errors"),
        documents.confidence(a, b, a, b, F.lit(1.0))["score"].alias("confidence"), qa.cast("int").alias("qa"),
    )


@Q.query("""
WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 101 END AS a, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey % 97 END AS b, o_orderkey % 89 AS c FROM orders),
r AS (SELECT k, floor((coalesce(a, 0) * 0.2::DOUBLE + CASE WHEN b = -1 THEN 0.0::DOUBLE ELSE b * 0.3::DOUBLE END + c * 0.5::DOUBLE) / (CASE WHEN a IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END + CASE WHEN b = -1 THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END + 0.5::DOUBLE) + 0.5) AS raw FROM p),
s AS (SELECT k, CASE WHEN k % 10 = 0 THEN least(raw, 60) WHEN k % 4 = 0 THEN least(raw, 85) ELSE raw END AS score FROM r)
SELECT k, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 60 THEN 'fair' WHEN score >= 40 THEN 'poor' ELSE 'critical' END AS status FROM s""")
def evaluations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    parts = table(spark, d, "orders").select(k.alias("k"), F.when(k % 6 != 0, k % 101).alias("a"), F.when(k % 5 == 0, -1).otherwise(k % 97).alias("b"), (k % 89).alias("c"))
    return scoring.evaluation(parts, {"a": 0.2, "b": 0.3, "c": 0.5}, F.col("k") % 10 == 0, F.col("k") % 4 == 0).select("k", "score", "grade", "status")


@Q.query("""
SELECT p_partkey, CASE WHEN p_size / 10.0 > 2.5 THEN 'high' WHEN p_size / 10.0 > 2 THEN 'medium' WHEN p_size / 10.0 > 1.5 THEN 'low' END AS deductible,
  least(100, CASE p_size % 3 WHEN 0 THEN 15 WHEN 1 THEN 8 ELSE 3 END + CASE p_size % 2 WHEN 0 THEN 12 ELSE 6 END + 3 + CASE WHEN p_size % 5 = 0 THEN 8 ELSE 1 END + 4) AS gap,
  floor((100 + p_retailprice * 0.1 * (CASE WHEN p_size > 0 THEN log2(50.0 / p_size) ELSE 0 END * 0.15)) * 1.2 + 0.5) AS cost FROM part""")
def gap_details(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    lists = [
        F.array(by_case(size % 3, F.lit("critical"), F.lit("recommended"), F.lit("optional"))), F.array(by_case(size % 2, F.lit("high"), F.lit("medium"))),
        F.array(F.lit("medium")), F.array(F.when(size % 5 == 0, "high").otherwise("low"), F.lit("medium")),
    ]
    return table(spark, d, "part").select(
        "p_partkey", scoring.deductible_gap(size, F.lit(10.0)).alias("deductible"), scoring.market_gap_score(*lists).alias("gap"), scoring.closure_cost(F.lit(100.0), F.lit(1.2), F.col("p_retailprice"), size, F.lit(50.0)).alias("cost")
    )


@Q.query(f"""SELECT doc_id, regexp_matches(text, '{text.INJECTION}') AS injected, contains(lower(text), 'copyright') OR contains(lower(text), 'the of') AS phrase FROM documents""")
def unsafe_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.looks_injected("text").alias("injected"), text.contains_phrase("text", ["Copyright", "the of"]).alias("phrase"))


@Q.query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents), t AS (SELECT doc_id, no, trim(line, ' ') AS t FROM l),
m AS (SELECT *, length(t) AS n, length(t) - length(regexp_replace(t, '[\\x{80}-\\x{ff}]', '', 'g')) AS high, length(t) - length(regexp_replace(t, '[\\x00-\\x1f\\x7f-\\x{9f}\\x{fffd}]', '', 'g')) AS control, regexp_replace(t, '\\s', '', 'g') AS solid FROM t)
SELECT * FROM (SELECT doc_id, CAST(no AS INTEGER) AS line, CASE WHEN n = 0 THEN NULL WHEN regexp_matches(t, '^[|!Il1\\s]{10,}$') OR regexp_matches(t, '^[^\\p{L}\\p{N}\\s]{6,}$') THEN 'barcode' WHEN high > 10 OR high / n > 0.3 THEN 'high_ascii' WHEN control > 5 OR control / n > 0.2 THEN 'control'
  WHEN length(solid) > 40 AND length(regexp_replace(solid, '[^a-zA-ZçğıöşüÇĞİÖŞÜâîûÂÎÛ]', '', 'g')) / length(solid) < 0.15 THEN 'few_letters' END AS reason FROM m) WHERE reason IS NOT NULL""")
def garbage_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = spread(table(spark, d, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", "line", text.garbage_reason("t").alias("reason")).filter("reason is not null")


@Q.query("""SELECT o_orderkey AS k, 'POLICY no ' || o_orderkey || ' A B1 cd' AS merged, 'see https://a.org/' || o_orderkey || ' and www.b.org mail a.b@c.org now' AS links FROM orders""")
def mended_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    spaced = F.concat(F.lit("P O L I C Y no "), k, F.lit(" A B1 cd"))
    links = F.concat(F.lit("see https : // a.org/"), k, F.lit("., and www . b.org; mail a.b @ c.org now"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), text.merge_spaced_capitals(spaced).alias("merged"), text.clean_links(links).alias("links"))


@Q.query(f"""
SELECT k, section, n_lines, n_chars FROM (SELECT k, unnest([{{'s': 'none', 'l': 1, 'c': length('intro ' || k)}}, {{'s': 'a', 'l': 2, 'c': 6 + length(status)}}, {{'s': 'b', 'l': 3, 'c': 6 + length(priority) + 4}}]) AS x FROM ({MONEY})), LATERAL (SELECT x.s AS section, CAST(x.l AS BIGINT) AS n_lines, CAST(x.c AS BIGINT) AS n_chars)""")
def section_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = money(spark, d).select("k", put("intro ", "{k}", "\nPART A\n", "{status}", "\nPart b\n", "{priority}", "\nmore").alias("t"))
    return documents.sections(rows, "k", "t", [("(?i)^part a$", "a"), ("(?i)^part b$", "b")])


@Q.query(f"""SELECT k, CAST(k AS VARCHAR) AS number, CAST(whole AS VARCHAR) AS premium, priority AS insurer, CAST(NULL AS VARCHAR) AS absent FROM ({MONEY})""")
def labelled_values(spark: SparkSession, d: str) -> DataFrame:
    t = put("Policy no : ", "{k}", "\n| Premium | ", "{whole}", " |\nInsurer\n  ", "{priority}", "\n")
    return money(spark, d).select("k", extraction.labelled(t, ["number", "policy no"]).alias("number"), extraction.labelled(t, ["premium"]).alias("premium"), extraction.labelled(t, ["insurer"]).alias("insurer"), extraction.labelled(t, ["expiry"]).alias("absent"))


@Q.query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN lpad(CAST(o_orderkey % 81 + 1 AS VARCHAR), 2, '0') || 'AB' || (100 + o_orderkey % 900) END AS plate, CASE WHEN o_orderkey % 3 > 0 THEN 'WVWZZZ1KZ' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS vin, CAST(1990 + o_orderkey % 35 AS INTEGER) AS year FROM orders""")
def vehicles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    plate = F.when(k % 5 > 0, F.concat(pad(k % 81 + 1, 2), F.lit(" ab "), (100 + k % 900).cast("string"))).otherwise("no plate")
    vin = F.when(k % 3 > 0, F.concat(F.lit(", wvwzzz1kz"), pad(k, 8))).otherwise("")
    t = F.concat(F.lit("Vehicle "), plate, vin, F.lit(", built "), (1990 + k % 35).cast("string"), F.lit("."))
    return table(spark, d, "orders").select(k.alias("k"), extraction.vehicle(t).alias("v")).select("k", "v.*")


@Q.query(f"""SELECT k, 'Dear ' || status || ', no ' || k || CASE WHEN k % 2 = 0 THEN '' ELSE ' pays ' || whole END || '.' AS letter FROM ({MONEY})""")
def letters(spark: SparkSession, d: str) -> DataFrame:
    template = F.lit("Dear {{name}}, no {{number}}{{#if sum}} pays {{sum}}{{/if}}{{#if gift}} and {{gift}}{{/if}}.{{unknown}}")
    values = F.create_map(F.lit("name"), F.col("status"), F.lit("number"), F.col("k").cast("string"), F.lit("sum"), F.when(F.col("k") % 2 == 0, "").otherwise(F.col("whole").cast("string")), F.lit("gift"), F.lit(None).cast("string"))
    return money(spark, d).select("k", text.render_template(template, values).alias("letter"))


@Q.query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'rest' END AS region, CASE o_orderkey % 4 WHEN 0 THEN '34' WHEN 1 THEN '01' WHEN 2 THEN '34' END AS province FROM orders""")
def places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    t = F.concat(F.lit("Street "), k.cast("string"), by_case(k % 4, F.lit(", Alpha / Beta"), F.lit(" beta!"), F.lit(" Alphabet 34."), F.lit(" Gammas")))
    names = [("alpha", "north"), ("beta", "south")]
    return table(spark, d, "orders").select(k.alias("k"), extraction.place(t, names, "rest").alias("region"), extraction.province(t, [("alpha", "34"), ("beta", "01")]).alias("province"))


@Q.query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'individual' WHEN o_orderkey % 3 = 1 THEN 'corporate' END AS entity, sha256('id ' || o_orderkey) AS hash FROM orders""")
def entity_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    number = by_case(k % 3, pad(k, 11), F.concat(pad(k, 7), F.lit(" 123")), F.lit("12"))
    return table(spark, d, "orders").select(k.alias("k"), text.entity_type(number).alias("entity"), F.sha2(F.concat(F.lit("id "), k.cast("string")), 256).alias("hash"))


# Limits per unit and per accident that stand for one another, and how far a reading may be off.
LIMIT_PAIRS = [(300_000.0, 600_000.0), (2_700_000.0, 13_500_000.0)]


@Q.query("""
SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS same FROM orders""")
def equivalent_limits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    a = by_case(k % 5, F.lit(300_000.0), F.lit(13_000_000.0), F.lit(300_000.0), F.lit(5.0), F.lit(None).cast("double"))
    b = by_case(k % 5, F.lit(610_000.0), F.lit(2_700_000.0), F.lit(2_700_000.0), F.lit(5.0), F.lit(1.0))
    return table(spark, d, "orders").select(k.alias("k"), numbers.equivalent(a, b, LIMIT_PAIRS).alias("same"))


@Q.query(f"""
SELECT k, k % 3 <> 2 AS known, CASE WHEN k % 8 <= 2 THEN 'pass' WHEN k % 6 / (k % 8)::DOUBLE >= 0.9 THEN 'pass' WHEN k % 6 / (k % 8)::DOUBLE < 0.5 AND k % 8 - k % 6 >= 5 THEN 'critical' ELSE 'warn' END AS parity FROM ({MONEY})""")
def label_parity(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    label = by_case(k % 3, F.lit("Glass breakage cover"), F.lit("glass and more"), F.lit("unheard of thing"))
    known = F.array(F.lit("Broken glass breakage"), F.lit("and more fire"))
    return money(spark, d).select("k", policies.known_share(label, known).alias("known"), policies.parity(k % 8, k % 6).alias("parity"))
