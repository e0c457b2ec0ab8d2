"""Registered queries of the receipt operators, with SQL that names the values the text was rendered from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import banks, dates, merge, money, references, text
from ..operators import acquire
from ..operators import extract as ex
from ..operators import relational as rel
from ..sources.files import export_rows, history_entries
from ..sources.render import BANKS, receipts
from .registry import QUERIES, SQL, query  # noqa: F401
from .registry import table as _table

def _bank_sql(expr: str) -> str:
    return f"[{', '.join(repr(b['name']) for b in BANKS)}][({expr}) % {len(BANKS)} + 1]"


AMOUNT_SQL, DATE_SQL, REF_SQL = "CAST(o_totalprice AS DECIMAL(11,2))", "CAST(o_orderdate AS DATE)", "'TX' || lpad(o_orderkey::VARCHAR, 8, '0')"
LAYOUT_SQL = "o_orderkey % 6"


@query(f"""SELECT o_orderkey AS doc_id, {_bank_sql('o_custkey')} AS bank, {_bank_sql('o_custkey + 5')} AS beneficiary_bank, {REF_SQL} AS reference_id, {DATE_SQL} AS date, {AMOUNT_SQL} AS amount,
CAST(0.53 AS DECIMAL(11,2)) AS fee, CASE WHEN {LAYOUT_SQL} IN (0, 1, 5) THEN CAST({AMOUNT_SQL} + 0.53 AS DECIMAL(11,2)) END AS total_debit, 'Payer House ' || o_custkey AS payer, 'Supply Works ' || o_orderkey AS beneficiary,
'Interbank GIRO (IBG)' AS payment_mode, CAST(CASE {LAYOUT_SQL} WHEN 2 THEN 0.948 WHEN 3 THEN 0.935 WHEN 4 THEN 0.885 ELSE 0.965 END AS DECIMAL(4,3)) AS overall_confidence, FALSE AS needs_review, TRUE AS is_ibg FROM orders""")
def flagship_extract_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every receipt."""
    return ex.extract(receipts(spark, sf_dir)).select("doc_id", "bank", "beneficiary_bank", "reference_id", "date", "amount", "fee", "total_debit", "payer", "beneficiary", "payment_mode", "overall_confidence", "needs_review", "is_ibg")


@query(f"SELECT {LAYOUT_SQL} AS layout, CASE {LAYOUT_SQL} WHEN 2 THEN 'label:weak' WHEN 3 THEN 'label:weak:above' WHEN 4 THEN 'currency_prefix:RM' ELSE 'label:strong' END AS amount_source, sum({AMOUNT_SQL})::DECIMAL(28,2) AS amount, count(*) AS n FROM orders GROUP BY ALL")
def amount_by_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts found inline, above or below their label, and by currency alone."""
    found = money.with_money(receipts(spark, sf_dir))
    return found.groupBy(F.pmod("doc_id", F.lit(6)).alias("layout"), "amount_source").agg(F.sum("amount").cast("decimal(28,2)").alias("amount"), F.count("*").alias("n"))


@query(f"SELECT CASE WHEN {LAYOUT_SQL} = 5 THEN 'label:fee' ELSE 'fee:sum_of_components' END AS fee_source, sum(0.53)::DECIMAL(28,2) AS fee, count(*) AS n, count(CASE WHEN {LAYOUT_SQL} IN (0, 1, 5) THEN 1 END) AS with_total FROM orders GROUP BY ALL")
def fees_and_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees as sums or restated totals; totals only where printed."""
    found = money.with_money(receipts(spark, sf_dir))
    return found.groupBy("fee_source").agg(F.sum("fee").cast("decimal(28,2)").alias("fee"), F.count("*").alias("n"), F.count("total_debit").alias("with_total"))


@query(f"SELECT {DATE_SQL} AS date, 1 AS date_tier, count(*) AS n FROM orders GROUP BY ALL")
def dates_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in four formats, month first for one bank; print stamps never win."""
    found = banks.with_issuer(receipts(spark, sf_dir))
    return dates.with_date(found, F.col("bank_key")).groupBy("date", "date_tier").agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey AS doc_id, {REF_SQL} AS value, 'bank_primary' AS role FROM orders UNION ALL SELECT o_orderkey, 'INV' || o_custkey, 'payer_supplied' FROM orders")
def references_all_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference with its role."""
    return references.with_references(receipts(spark, sf_dir)).select("doc_id", F.explode("references").alias("r")).select("doc_id", "r.value", "r.role")


@query(f"SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'PN' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'TR' || o_orderkey END AS reference_id, CASE WHEN o_orderkey % 3 = 0 THEN 'bank_primary' WHEN o_orderkey % 3 = 1 THEN 'bank_secondary,bank_primary' ELSE '' END AS roles FROM orders")
def reference_demoted_promoted_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lone secondary reference is promoted, "Bank Reference" gives way to a main one, a dash is a blank."""
    k = F.col("o_orderkey").cast("string")
    body = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("PayNet Reference No : PN"), k)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Bank Reference : BR"), k, F.lit("\nTransaction Reference : TR"), k)).otherwise(F.lit("Transaction Reference : -\nDate : x"))
    found = references.with_references(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), body.alias("text")))
    return found.select("doc_id", "reference_id", F.array_join(F.transform("references", lambda r: r["role"]), ",").alias("roles"))


@query(f"SELECT {_bank_sql('o_custkey')} AS bank, {_bank_sql('o_custkey + 5')} AS beneficiary_bank, count(*) AS n FROM orders GROUP BY ALL")
def banks_of_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuer and beneficiary bank; the beneficiary's never becomes the issuer."""
    return banks.with_banks(receipts(spark, sf_dir)).groupBy("bank", "beneficiary_bank").agg(F.count("*").alias("n"))


@query(f"SELECT bic, count(*) AS n FROM (SELECT [{', '.join(repr(b['bic']) for b in BANKS)}][o_custkey % {len(BANKS)} + 1] AS bic FROM orders) GROUP BY bic")
def bank_by_bic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of eight or eleven letters joined to the registry, a fixed small table."""
    code = F.element_at(F.array(*[F.lit(b['bic']) for b in BANKS]), (F.col("o_custkey") % len(BANKS) + 1).cast("int"))
    codes = _table(spark, sf_dir, "orders").select(F.substring(F.concat(code, F.when(F.col("o_orderkey") % 2 == 0, "XXX").otherwise("")), 1, 8).alias("bic"))
    return codes.join(F.broadcast(banks.registry(spark).select("bic").distinct()), "bic").groupBy("bic").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, doc_id % 4 IN (1, 2) OR length(trim(coalesce(text, ''))) < 50 AS garbage FROM documents""")
def garbage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that acquisition refuses: short ones, codes in place of characters, characters that can't be printed."""
    docs, k = _table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    t = F.coalesce("text", F.lit(""))
    spoilt = F.when(k == 1, F.concat(t, F.lit(" (cid:1)(cid:22)(cid:3)"))).when(k == 2, F.concat(F.lit("abc"), F.repeat(F.lit("\u0003\u0004"), F.length(t) + 50), t)).when(k == 3, F.concat(t, F.lit(" (cid:1)(cid:2)"))).otherwise(t)
    # Two codes are no garbage, but they make a text longer: cut it back.
    spoilt = F.when((k == 3) & (F.length(F.trim(t)) < 50), t).otherwise(spoilt)
    return docs.select("doc_id", text.is_garbage(spoilt).alias("garbage"))


@query("""SELECT doc_id, CASE WHEN length(trim(text)) < 50 OR text IS NULL THEN 'none' ELSE ['embedded', 'ocr', 'vision', 'pdfplumber'][doc_id % 4 + 1] END AS text_source,
CASE WHEN length(trim(text)) < 50 OR text IS NULL THEN 0 ELSE [0.7, 0.81, 0.66, 0.4][doc_id % 4 + 1] END::DECIMAL(4,3) AS confidence, text IS NULL OR length(trim(text)) < 50 OR doc_id % 4 IN (1, 2) AS ocr_used FROM documents""")
def acquisition_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rung with usable text counts, with its confidence; four rungs, and none."""
    k = F.col("doc_id") % 4
    have = {rung: F.when(k == i, F.col("text")) for i, rung in enumerate(("embedded", "ocr", "vision", "pdfplumber"))}
    chosen = acquire.ladder(have, {"ocr": F.lit("0.81"), "vision": F.lit("0.66")})
    return _table(spark, sf_dir, "documents").select("doc_id", chosen.alias("c")).select("doc_id", F.col("c.source").alias("text_source"), "c.confidence", "c.ocr_used")


@query(f"""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 'both' WHEN o_orderkey % 4 = 1 THEN 'conflict' WHEN o_orderkey % 4 = 2 THEN 'local' ELSE 'other' END AS source,
CASE WHEN o_orderkey % 4 = 1 THEN {REF_SQL} || 'X9' ELSE {REF_SQL} END AS value, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1.00 WHEN 1 THEN 0.70 WHEN 2 THEN 0.85 ELSE 0.90 END AS DECIMAL(3,2)) AS confidence FROM orders""")
def merge_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of two sources merged: equal, different, or only one valid."""
    k = F.col("o_orderkey")
    ref = F.concat(F.lit("TX"), F.lpad(k.cast("string"), 8, "0"))
    local, other = F.when(k % 4 != 3, ref).otherwise(F.lit("none")), F.when(k % 4 == 0, F.lower(ref)).when(k % 4 == 1, F.concat(ref, F.lit("x9"))).when(k % 4 == 3, ref)
    return _table(spark, sf_dir, "orders").select(k.alias("doc_id"), merge.merge("id", local, other).alias("m")).select("doc_id", "m.value", "m.confidence", "m.source")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def history_latest_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty rows: a top-k report."""
    return rel.newest(_table(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type")


@query(f"SELECT o_orderkey::VARCHAR AS doc_id, {REF_SQL} AS bank_references, 'INV' || o_custkey AS payer_references, CAST({AMOUNT_SQL} AS VARCHAR) AS amount, CAST({DATE_SQL} AS VARCHAR) AS date FROM orders")
def history_export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the export."""
    return export_rows(ex.extract(receipts(spark, sf_dir))).select("doc_id", "bank_references", "payer_references", "amount", "date")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def history_update_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known columns of known rows take the updates' values."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return rel.update_known(c, c.where("c_custkey % 7 = 0").select("c_custkey", F.lit("UPDATED").alias("c_mktsegment"), F.lit(1).alias("unknown")), "c_custkey")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ingest_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't ingested yet."""
    return _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE source IS NOT NULL GROUP BY source")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each source; nulls aren't counted."""
    return _table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events) WHERE rank <= 3")
def items_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three items of every user."""
    return rel.top_in_group(_table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "rank")


@query(f"SELECT {_bank_sql('o_custkey')} AS bank, count(*) AS receipts, count(*) AS with_amount, count(CASE WHEN {LAYOUT_SQL} IN (0, 1, 5) THEN 1 END) AS with_total, 0::BIGINT AS for_review, 2.0::DECIMAL(4,2) AS mean_references FROM orders GROUP BY ALL")
def audit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each field was found, by bank."""
    r = ex.extract(receipts(spark, sf_dir))
    return r.groupBy("bank").agg(F.count("*").alias("receipts"), F.count("amount").alias("with_amount"), F.count("total_debit").alias("with_total"), F.count_if("needs_review").alias("for_review"), F.avg(F.size("references")).cast("decimal(4,2)").alias("mean_references"))


@query(f"SELECT o_orderpriority AS grp, grouping(o_orderpriority)::INT AS whole, count(*) AS n, count(CASE WHEN {LAYOUT_SQL} <> 4 THEN 1 END) AS labelled FROM orders GROUP BY ROLLUP (o_orderpriority)")
def evaluation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by group and over all in one pass."""
    found = money.with_money(receipts(spark, sf_dir)).select("doc_id", "amount_source").join(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("grp")), "doc_id")
    return found.rollup("grp").agg(F.grouping("grp").cast("int").alias("whole"), F.count("*").alias("n"), F.count_if(F.col("amount_source").startswith("label")).alias("labelled"))


@query(r"SELECT p_brand, format, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, format) AS rank FROM (SELECT p_brand, format, count(*) AS n FROM (SELECT p_brand, CASE WHEN regexp_matches(p_name, '^[A-Za-z]+$') THEN 'alpha_' || length(p_name) ELSE 'mixed_special' END AS format FROM part) GROUP BY p_brand, format)) WHERE rank <= 5")
def format_frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five commonest shapes of names for every brand."""
    counts = _table(spark, sf_dir, "part").groupBy("p_brand", text.format_class(F.col("p_name")).alias("format")).agg(F.count("*").alias("n"))
    return rel.top_in_group(counts, ["p_brand"], [F.desc("n"), F.col("format")], 5).select("p_brand", "format", "n")


@query("SELECT user_id, island::BIGINT AS island, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, island")
def touching_runs_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events with no gap of over twelve hours."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    runs = rel.islands(e, "user_id", ["ts", "event_id"], F.col("ts") - F.col("_prev.ts") > F.expr("interval 12 hours"))
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
l AS (SELECT *, min(CASE WHEN event_type = 'click' THEN n END) OVER w AS next_label, min(CASE WHEN event_type = 'purchase' THEN n END) OVER w AS next_value FROM e WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT l.event_id, v.event_id AS matched FROM l LEFT JOIN e v ON v.user_id = l.user_id AND v.n = l.next_value AND (l.next_label IS NULL OR l.next_value < l.next_label) WHERE l.event_type = 'click'""")
def asof_next_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each click the first purchase before the user's next click."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type").withColumn("value_id", F.col("event_id"))
    return rel.next_match(e, "user_id", ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase", "value_id").select("event_id", "matched")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'No 12545 paid' ELSE 'No l2S45 paid' END AS fixed FROM orders")
def ocr_repair_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confused letters become digits only where the text came from OCR."""
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), text.repair_digits(F.lit("No l2S45 paid"), F.col("o_orderkey") % 2 == 0).alias("fixed"))


@query("SELECT o_orderkey AS doc_id, 'RM ' || CAST(o_custkey % 9 AS VARCHAR) || '.50' AS fixed FROM orders")
def doubled_text_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text whose characters were printed twice."""
    d = (F.col("o_custkey") % 9).cast("string")
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.undouble(F.concat(F.lit("RRMM  "), d, d, F.lit("..5500"))).alias("fixed"))


@query("SELECT p_partkey, (length(p_name) - length(replace(p_name, ' ', '')))::INT AS blanks, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def name_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of names."""
    return _table(spark, sf_dir, "part").select("p_partkey", F.regexp_count("p_name", F.lit(" ")).alias("blanks"), text.slug(F.col("p_name")).alias("slug"))


@query("SELECT quality, count(*) AS n, sum(CASE WHEN (n_chars > 800) = (quality = 1) THEN 1 ELSE 0 END)::BIGINT AS right_ones, sum(CASE WHEN n_chars > 800 THEN 1 ELSE 0 END)::BIGINT AS predicted FROM labels JOIN documents USING (doc_id) GROUP BY quality")
def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of a length rule against labels."""
    j = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    hit = (F.col("n_chars") > 800) == (F.col("quality") == 1)
    return j.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(hit).alias("right_ones"), F.count_if(F.col("n_chars") > 800).alias("predicted"))


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)")
def dataset_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred items, oldest first: a top-k report."""
    return rel.last_items(_table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "user_id")


@query("""SELECT a.event_id, arg_min(b.event_id, struct_pack(d := abs(a.event_id - b.event_id), e := b.event_id)) AS nearest FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' WHERE a.event_type = 'click' GROUP BY a.event_id""")
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each click the user's purchase whose number is nearest."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").withColumn("at", F.col("event_id"))
    buys = e.where("event_type = 'purchase'").withColumn("v", F.col("event_id"))
    return rel.nearest(e.where("event_type = 'click'").select("event_id", "user_id", "at"), buys.select("user_id", "at", "v"), "user_id", "at", "v").select("event_id", "nearest")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT a.event_id, arg_min(b.event_id, b.n) AS found FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND b.n > a.n AND b.n <= a.n + 8 AND b.event_type = 'purchase' WHERE a.event_type = 'click' GROUP BY a.event_id""")
def look_ahead_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each click the first purchase among the user's next eight events."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type").withColumn("v", F.col("event_id"))
    return rel.looking_ahead(e, "user_id", ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase", "v").select("event_id", "found")


@query("SELECT o_orderkey AS doc_id, 'success' AS status, 'TX' || lpad(o_orderkey::VARCHAR, 8, '0') AS reference_id FROM orders")
def history_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the history with their status."""
    return history_entries(ex.extract(receipts(spark, sf_dir))).select("doc_id", "status", "reference_id")


from . import engine_queries, evaluation_queries, older_queries  # noqa: E402, F401
