"""Deterministic inputs derived from the given tables, one function per view.

Each derivation is a projection of a given table with integer arithmetic, so it
grows with that table and both engines compute it identically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docweir.functions.checkdigit import check_digit
from docweir.session import spread

SURNAMES = ["ALIYEV", "KARIMOV", "RAHMONOV", "YUSUPOV", "TOSHMATOV", "QODIROV",
            "SAIDOV", "NAZAROV", "ISMOILOV", "XOLMATOV", "ERGASHEV", "MIRZAYEV"]
SMALLEST_FROM = "0123456789ABCDEFGIKLMNOPQRSTUVXZ"
SMALLEST_TO = "DIZ8ASGT3G48G0FE61X1NM0R0P57VUK2"
# Tables whose rows cost much work each, and the key they are spread by.
SPREAD = {"customer": "c_custkey", "documents": "doc_id", "pages": "page_id", "part": "p_partkey"}
TODAY = "2026-01-01"
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, SPREAD[name]) if name in SPREAD else df


def today() -> Column:
    return F.lit(TODAY).cast("date")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    male = k % 2 == 0
    names = F.array(*[F.lit(s) for s in SURNAMES])
    birth = F.date_add(F.lit("1960-01-01").cast("date"), ((k * 37) % 16800).cast("int"))
    expiry = F.date_add(F.lit("2026-01-01").cast("date"), ((k * 13) % 3650).cast("int"))
    df = base.select(
        k.alias("doc_id"),
        F.when(male, "M").otherwise("F").alias("sex"),
        birth.alias("birth"), expiry.alias("expiry"),
        F.concat(F.char(65 + k % 26), F.char(65 + F.floor(k / 26) % 26),
                 _pad((k * 7919) % 10000000, 7)).alias("doc_no"),
        F.get(names, (k % 12).cast("int")).alias("surname"),
        F.when(male, "AKMAL").otherwise("MADINA").alias("given"))
    old = F.year("birth") < 2000
    marker = (F.when(old & (F.col("sex") == "M"), "3").when(old, "4")
              .when(F.col("sex") == "M", "5").otherwise("6"))
    d = F.col("doc_id")
    return df.withColumn("pinfl", F.concat(
        marker, F.date_format("birth", "ddMMyy"), _pad(10 + d % 24, 2),
        _pad(d % 10000, 4), (d % 10).cast("string")))


def _zones(p: DataFrame) -> DataFrame:
    b, e = F.date_format("birth", "yyMMdd"), F.date_format("expiry", "yyMMdd")

    def cd(c: Column, width: int) -> Column:
        return check_digit(c, width).cast("string")

    l1 = F.rpad(F.concat(F.lit("IDUZB"), "doc_no", cd(F.col("doc_no"), 9), "pinfl"), 30, "<")
    head = F.rpad(F.concat(b, cd(b, 6), "sex", e, cd(e, 6), F.lit("UZB")), 29, "<")
    out = p.withColumn("l1", l1).withColumn("_h", head)
    source = F.concat(F.substring("l1", 6, 25), F.substring("_h", 1, 7),
                      F.substring("_h", 9, 7), F.substring("_h", 19, 11))
    return (out.withColumn("l2", F.concat("_h", check_digit(source).cast("string")))
            .withColumn("l3", F.rpad(F.concat("surname", F.lit("<<"), "given"), 30, "<"))
            .drop("_h"))


def mrz_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One valid three-line zone per person."""
    return _zones(persons(spark, sf_dir)).withColumn("lines", F.array("l1", "l2", "l3"))


def mrz_td3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One valid two-line zone per person."""
    p = persons(spark, sf_dir)
    b, e = F.date_format("birth", "yyMMdd"), F.date_format("expiry", "yyMMdd")

    def cd(c: Column, width: int) -> Column:
        return check_digit(c, width).cast("string")

    head = F.concat("doc_no", cd(F.col("doc_no"), 9), F.lit("UZB"), b, cd(b, 6), "sex",
                    e, cd(e, 6), "pinfl", cd(F.col("pinfl"), 14))
    out = p.withColumn("_h", head)
    source = F.concat(F.substring("_h", 1, 10), F.substring("_h", 14, 7),
                      F.substring("_h", 22, 22))
    return (out.withColumn("l2", F.concat("_h", check_digit(source).cast("string")))
            .withColumn("l1", F.rpad(F.concat(F.lit("P<UZB"), "surname", F.lit("<<"), "given"),
                                     44, "<"))
            .drop("_h").withColumn("lines", F.array("l1", "l2")))


def corrupt_mrz(df: DataFrame, every: int = 5) -> DataFrame:
    """Replace one document-number glyph in every n-th zone, and a birth zero in every 5n-th."""
    d = F.col("doc_id")
    place = (1 + d % 9).cast("int")
    glyph = F.substring(F.col("l1"), 5 + place, F.lit(1))
    bad = F.translate(glyph, SMALLEST_FROM, SMALLEST_TO)
    zero = F.instr(F.substring("l2", 1, 6), "0")
    hit = d % every == 0
    return (df.withColumn("true_doc_no", F.substring("l1", 6, 9))
            .withColumn("char_conf", F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.when(
                hit & (d % 2 == 0) & (i == place), F.lit(0.2)).otherwise(F.lit(0.99))))
            .withColumn("l1", F.when(hit, F.overlay("l1", bad, 5 + place, F.lit(1)))
                        .otherwise(F.col("l1")))
            .withColumn("l2", F.when((d % (5 * every) == 0) & (zero > 0),
                                     F.overlay("l2", F.lit("O"), zero, F.lit(1)))
                        .otherwise(F.col("l2")))
            .withColumn("lines", F.array("l1", "l2", "l3")))


def mrz_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones as a recogniser would read them, with glyph errors."""
    return corrupt_mrz(mrz_clean(spark, sf_dir))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines: labelled values, then the (partly misread) zone."""
    z = mrz_ocr(spark, sf_dir)
    d = F.col("doc_id")
    pairs = [("Familiyasi:", F.col("surname")), ("Ismi:", F.col("given")),
             ("Tug'ilgan sanasi:", F.date_format("birth", "dd.MM.yyyy")),
             ("JSHSHIR", F.col("pinfl")), ("Seriya", F.col("true_doc_no")),
             ("Jinsi:", F.col("sex"))]
    split = d % 3 == 0
    rows = [F.array(F.lit("O'ZBEKISTON RESPUBLIKASI"))]
    for label, value in pairs:
        both = F.when(split, F.array(F.lit(label), value)).otherwise(
            F.array(F.concat(F.lit(label + " "), value)))
        if label == "JSHSHIR":
            both = F.when(d % 7 == 0, F.array().cast("array<string>")).otherwise(both)
        rows.append(both)
    # Two fillers make the first line recognisable as part of a zone.
    rows.append(F.array(F.concat(F.lit("I<"), F.expr("substring(l1, 3)")), F.col("l2"), F.col("l3")))
    out = z.select("doc_id", F.posexplode(F.concat(*rows)).alias("pos", "text"))
    return out.select("doc_id", (F.col("pos") + 1).alias("line_no"), "text",
                      F.array(F.lit(0), F.col("pos") * 20, F.lit(200), F.col("pos") * 20 + 18)
                      .alias("bbox"),
                      (0.80 + (d + F.col("pos")) % 20 / 100).alias("confidence"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies: one JSON object per person, some fenced, some wrong, some broken."""
    p, d = persons(spark, sf_dir), F.col("doc_id")
    pinfl = F.when(d % 4 == 0, F.concat(F.substring("pinfl", 1, 13),
                                        ((d + 1) % 10).cast("string"))).otherwise(F.col("pinfl"))
    address = F.when(d % 6 == 0, "Toshkent").otherwise("O'ZBEKISTON")
    # One letter lost, two letters misread, and a place that the text does not name.
    birth_place = F.when(d % 4 == 0, "OZBEKISTON RESPUBLIKSI").when(d % 4 == 1, "UZBEKISTAN RESPUBLIKASI").when(
        d % 4 == 2, "TOSHKENT SHAHRI").otherwise("O'zbekiston Respublikasi")
    body = F.concat(F.lit('{"person.name.surname_latin": "'), "surname",
                    F.lit('", "person.pinfl": "'), pinfl,
                    F.lit('", "person.birth_date": "'), F.date_format("birth", "yyyy-MM-dd"),
                    F.lit('", "person.address": "'), address, F.lit('", "person.birth_place": "'), birth_place,
                    F.lit('", "person.phone": null}'))
    reply = (F.when(d % 11 == 0, F.concat(F.lit("no json "), "surname"))
             .when(d % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
             .when(d % 5 == 0, F.concat(F.lit("Here it is: "), body, F.lit(" done")))
             .otherwise(body))
    return p.select("doc_id", reply.alias("reply"))


def image_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a vision model read on every second picture; every third address is marked illegible."""
    d = F.col("doc_id")
    body = F.concat(F.lit('{"values": {"person.phone": "+998'), F.substring("pinfl", 1, 9), F.lit('", "person.address": "RASM '), "surname",
                    F.lit('"}, "legible": {"person.address": '), F.when(d % 3 == 0, "false").otherwise("true"), F.lit("}}"))
    return persons(spark, sf_dir).where(d % 2 == 0).select("doc_id", body.alias("reply"))


def turned_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents refused before recognition: every ninth picture is bad, every ninth of no known type."""
    d = F.col("doc_id")
    return persons(spark, sf_dir).where((d % 9).isin(1, 4)).select(
        "doc_id", F.when(d % 9 == 1, "bad_quality").otherwise("unknown_doc_type").alias("status"))


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected values, long form (doc_id, path, value)."""
    p = persons(spark, sf_dir)
    return p.select("doc_id", F.inline(F.array(
        *[F.struct(F.lit(path).alias("path"), value.alias("value")) for path, value in [
            ("person.name.surname_latin", F.col("surname")),
            ("person.birth_date", F.date_format("birth", "yyyy-MM-dd")),
            ("person.pinfl", F.col("pinfl")),
            ("documents.0.doc_number", F.col("doc_no"))]])))


def actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted values: wrong for every tenth person, wrong and validated for every fiftieth."""
    d, path = F.col("doc_id"), F.col("path")
    wrong = (d % 10 == 0) & (path == "documents.0.doc_number")
    lost = (d % 14 == 0) & (path == "person.pinfl")
    return golden(spark, sf_dir).filter(~lost).select(
        "doc_id", "path",
        F.when(wrong, F.concat(F.lit("X"), "value")).otherwise(F.col("value")).alias("value"),
        F.when(wrong, d % 50 == 0).otherwise(path == "person.birth_date").alias("validated"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the outcome columns the metrics need."""
    d = F.col("doc_id")
    return persons(spark, sf_dir).select(
        "doc_id",
        F.when(d % 40 == 0, "bad_quality").when(d % 60 == 1, "unknown_doc_type")
        .otherwise("review_needed").alias("status"),
        F.when(d % 9 == 0, F.array(F.lit("L0_mrz"), F.lit("L3_vlm")))
        .otherwise(F.array(F.lit("L0_mrz"), F.lit("L1_rules"))).alias("stages_used"),
        (d % 7).cast("double").alias("llm_cost_usd"),
        F.array(F.struct(F.lit("ocr").alias("stage"), (100 + d % 50).cast("int").alias("ms"),
                         F.lit(True).alias("used")),
                F.struct(F.lit("L0_mrz").alias("stage"), (5 + d % 3).cast("int").alias("ms"),
                         (d % 4 != 0).alias("used"))).alias("timings"),
        (200 + (d * 37) % 900).cast("int").alias("processing_ms"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O",
                                                         "review_needed")
        .otherwise("failed").alias("status"),
        created.alias("created_at"), (created + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of existing jobs only; the job supplies the creation time."""
    return uploads_of(table(spark, sf_dir, "lineitem"))


def uploads_of(items: DataFrame) -> DataFrame:
    li = items.select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("n"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("size"),
        F.col("l_partkey").alias("part"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"))
    return li.withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL 24 HOURS")) \
        .withColumn("storage_key", F.concat_ws("/", F.lit("uploads"), F.col("job_id").cast("string"),
                                               F.col("n").cast("string"), F.col("part").cast("string")))


def gen_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered documents: one per order."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 5).alias("template_id"),
        F.concat(F.lit("documents/"), F.col("o_orderkey").cast("string")).alias("storage_key"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("expires_at"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual corrections; ``seq`` breaks ties between equal times."""
    from docweir.schema import CANONICAL_PATHS
    paths = F.array(*[F.lit(p) for p in CANONICAL_PATHS])
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("job_id"),
        F.get(paths, F.col("l_linenumber") % 26).alias("path"),
        F.concat(F.lit("V"), F.col("l_partkey").cast("string")).alias("value"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("seq"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider call log."""
    return calls_of(table(spark, sf_dir, "events"))


def calls_of(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("key-"), (F.col("user_id") % 5).cast("string")).alias("key_id"),
        F.concat(F.lit("provider-"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        F.concat(F.lit("model-"), (F.col("user_id") % 2).cast("string")).alias("model"),
        F.when(kind == "signup", "vision").otherwise("text_mapping").alias("task"),
        F.when(kind.isin("view", "purchase"), "ok").when(kind == "click", "rate_limited")
        .when(kind == "signup", "quota").when(F.col("event_id") % 7 < 2, "bad_request")
        .when(F.col("event_id") % 53 == 5, "invalid_key").otherwise("unavailable").alias("outcome"),
        F.when(kind.isin("click", "signup"), F.when(F.col("event_id") % 4 == 0, 4000.0).when(F.col("event_id") % 4 == 1, 0.0)
               .when(F.col("event_id") % 4 == 2, 12.5)).alias("retry_after"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("cost_micros"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
        (F.col("user_id") * 10).cast("bigint").alias("tokens_in"),
        (F.col("user_id") % 50).cast("bigint").alias("tokens_out"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven class scores per image, each from every seventh dimension; class 6 is the unknown class."""
    def score(k: int):
        own = F.filter("embedding", lambda x, i: i % 7 == k)
        return F.round(F.aggregate(own, F.lit(0.0), lambda a, x: a + x.cast("double")) * 10, 9)

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), (F.col("label") % 7).alias("label"),
        F.array(*[score(k) for k in range(7)]).alias("logits"))


# Literal templates, exercising every tag kind.
TEMPLATES = {
    0: "MA'LUMOTNOMA {{ extra.reference_number|default('____') }}: {{ person.name.surname_latin }} "
       "{{ person.name.given_name_latin }} ga berildi. Sana {{ person.birth_date|date_uz }}, "
       "JSHSHIR {{ person.pinfl|pinfl_spaced }}, manzil {{ person.address }}. {{ today|date_uz }}",
    1: "SHARTNOMA {{ person.name.surname_latin|upper_uz }} {{ documents[0].doc_number }} "
       "{{ documents[0].issue_date|date_uz_short }} ish haqi {{ extra.salary|default(0) }} "
       "({{ extra.salary|default(0)|amount_words }}). Xodim {% if person.sex == 'F' %}parvarish "
       "ta'tiliga{% else %}mehnat ta'tiliga{% endif %} chiqadi.",
    2: "ARIZA {{ person.name.surname_latin|cyrillic }} {{ person.citizenship|default('UZB') }} "
       "{{ education.institution }} {{ person.birth_date|date_ru }}",
    3: "ISHONCHNOMA {{ extra.city|default('Toshkent shahri') }} {{ person.birth_date|date_iso }} "
       "{{ person.middle_name }} {{ person.name.surname_latin|shout }}",
    4: "ILOVA {{ education.degree }} {%tr for s in education.subjects %}{{ s.name }}{%tr endfor %} "
       "{{ person.name.surname_latin }} {{ person.name.given_name_latin|initials }}",
    5: "YOMON {{ self.__class__.__mro__ }} {{ person.pinfl {% if config %}x{% endif %}",
}


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "template_id int, text string")


def template_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One template per part: a literal text by key, with its own typed-in value."""
    k = F.col("p_partkey")
    texts = F.array(*[F.lit(x) for x in TEMPLATES.values()])
    return table(spark, sf_dir, "part").select(
        k.alias("template_id"), F.concat(F.get(texts, (k % 6).cast("int")), F.lit(" {{ extra.x"), (k % 9).cast("string"),
                                         F.lit("|default('') }} "), "p_name").alias("text"))
