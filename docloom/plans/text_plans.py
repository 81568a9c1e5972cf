"""Queries of the text operators. Texts are rendered from relational rows by one SQL expression
that Spark and the checking engine share, so the right answers are known from the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.operators import classify, ocr, text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pad(x: str, n: int) -> str:
    return f"lpad(cast({x} as string), {n}, '0')"


K = "c_custkey"
EMAIL = f"concat('user', {K}, '@mail', {K} % 7, '.example.com')"
PHONE = f"concat('(', {pad(f'{K} % 900 + 100', 3)}, ') 555-', {pad(f'{K} % 10000', 4)})"
DATE = f"concat('03/', {pad(f'{K} % 28 + 1', 2)}, '/2024')"
TIME = f"concat('10:', {pad(f'{K} % 60', 2)}, ' AM')"
URL = f"concat('https://shop', {K} % 9, '.example.com/p/', {K})"
PRICE = f"concat('$12.', {pad(f'{K} % 100', 2)})"
CARD = f"concat('4111-2222-3333-', {pad(f'{K} % 10000', 4)})"
SSN = f"concat('123-45-', {pad(f'{K} % 10000', 4)})"
NOTE = f"concat('Contact ', {EMAIL}, ' or ', {PHONE}, ' on ', {DATE}, ' at {{', {TIME}, '}}. Site ', {URL}, ' costs ', {PRICE}, ' number ', {CARD}, ' ssn ', {SSN}, ' end; 12 Elm Street, Town')"
TYPES = (
    ("receipt", "Receipt: total 5, paid in cash; subtotal 4"), ("business_card", "Name, Phone, Fax and Website"), ("id_card", "birth eyes hair height weight"),
    ("form", "please sign and submit the form"), ("text_document", "chapter one, section two, page 3"), ("business_card", "name"), ("text_document", "nothing to see"),
)
TYPED = "case o_orderkey % 7 " + " ".join(f"when {i} then '{t}'" for i, (_, t) in enumerate(TYPES)) + " end"
TYPE_OF = "case o_orderkey % 7 " + " ".join(f"when {i} then '{k}'" for i, (k, _) in enumerate(TYPES)) + " end"


def cents(a: int) -> str:
    """dd.dd from a key."""
    c = f"(o_orderkey * {a} % 9000 + 1000)"
    return f"concat(cast(floor({c} / 100) as bigint), '.', {pad(f'{c} % 100', 2)})"


NL = "chr(10)"
SHOP = "concat('Shop ', chr(cast(97 + o_orderkey % 26 as int)))"
DAY = f"concat('01/', {pad('o_orderkey % 28 + 1', 2)}, '/2024')"
RECEIPT = (
    f"concat({SHOP}, {NL}, 'Date: ', {DAY}, {NL}, 'Time: 09:', {pad('o_orderkey % 60', 2)}, ' AM', {NL}, "
    f"o_orderkey % 5 + 1, ' x widget $', {cents(7)}, {NL}, o_orderkey % 3 + 1, ' gadget $', {cents(11)}, {NL}, "
    f"'Subtotal: $', {cents(13)}, {NL}, 'Tax: $', {cents(17)}, {NL}, 'Total: $', {cents(19)}, {NL}, 'Paid by ', case o_orderkey % 3 when 0 then 'VISA' when 1 then 'check, not cash' else 'barter' end)"
)
HOME = "concat('12 Elm Street, Town ', {0})"
VCARD = f"concat('  Person ', {K}, '  ', {NL}, 'Manager', {NL}, {NL}, 'ACME', {NL}, {PHONE}, ' ', '(999) 111-2222', {NL}, {EMAIL}, {NL}, case when {K} % 2 = 0 then {URL} else 'www.acme.example.com' end, {NL}, ';', {NL}, {HOME.format(K)})"
IDCARD = f"concat('ID: S', s_suppkey, {NL}, 'Name: ', s_name, {NL}, 'DOB: 02/', {pad('s_suppkey % 28 + 1', 2)}, '/1980', {NL}, 'Issued on: 03/04/2020', {NL}, 'Expires: 03/', {pad('s_suppkey % 28 + 1', 2)}, '/2030', {NL}, ';', {NL}, {HOME.format('s_suppkey')})"
FORM = f"concat('Request!', {NL}, '; City: town ', o_orderkey % 11, {NL}, ';Zip = ', o_orderkey, {NL}, '; City: last ', o_orderkey % 3, {NL}, ';', repeat('k', 31), ': dropped', {NL}, '; sign here')"


CARD_TEXT = f"concat('Person ', o_orderkey, {NL}, 'name title phone fax email website')"
ID_TEXT = f"concat('id: N', o_orderkey, {NL}, 'birth eyes hair height weight')"
SAID = f"case o_orderkey % 6 when 0 then {RECEIPT} when 1 then {FORM} when 2 then concat('chapter ', o_orderkey, ' figure') when 3 then {CARD_TEXT} when 4 then {ID_TEXT} else '  ' end"


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where they come in fewer parts, as small tables of one file do."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _rendered(spark: SparkSession, sf_dir: str, name: str, key: str, sql: str) -> DataFrame:
    return table(spark, sf_dir, name).select(key, F.expr(sql).alias("text"))


def txt_1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _rendered(spark, sf_dir, "customer", K, NOTE)
    return notes.select(K, F.explode(tx.entities(F.col("text"))).alias("entity", "found")).select(K, "entity", F.explode("found").alias("value"))


def txt_2_doc_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "orders", "o_orderkey", TYPED).select("o_orderkey", tx.doc_type(F.col("text")).alias("doc_type"))


def doc_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.distribution(txt_2_doc_type(spark, sf_dir), "doc_type").withColumn("percent", F.round("percent", 6))


def _fields(record, names: str) -> list:
    """Fields of a record, each taken from its expression, so that the others are not computed."""
    return [record[n].alias(n) for n in names.split()]


def txt_3_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(_rendered(spark, sf_dir, "orders", "o_orderkey", RECEIPT))
    return rows.select("o_orderkey", *_fields(tx.receipt(F.col("text")), "merchant date time total subtotal tax payment_method"))


def txt_3_receipt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spread(_rendered(spark, sf_dir, "orders", "o_orderkey", RECEIPT)).select("o_orderkey", F.explode(tx.items(F.col("text"))).alias("i"))
    return r.select("o_orderkey", F.col("i.quantity").cast("long").alias("quantity"), "i.description", "i.price", F.round("i.subtotal", 4).alias("subtotal"))


def txt_4_business_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "customer", K, VCARD).select(K, *_fields(tx.business_card(F.col("text")), "name title company phone mobile email website address"))


def txt_5_id_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "supplier", "s_suppkey", IDCARD).select("s_suppkey", *_fields(tx.id_card(F.col("text")), "id_number name date_of_birth issue_date expiration_date address"))


def txt_6_form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = tx.form(F.col("text"))
    return _rendered(spark, sf_dir, "orders", "o_orderkey", FORM).select("o_orderkey", *_fields(form, "title signature"), F.explode(form["fields"]).alias("field", "value"))


def txt_8_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rendered(spark, sf_dir, "orders", "o_orderkey", "concat(';Alpha: a', o_orderkey, chr(10), ';Beta = b', chr(10), ';Gamma   g ', o_orderkey % 5)")
    return r.select("o_orderkey", F.explode(tx.key_values(F.col("text"))).alias("field", "value"))


def txt_9_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rendered(spark, sf_dir, "customer", K, NOTE).select(K, tx.redact(F.col("text")).alias("redacted"))


def txt_10_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the type as a column of its own, so that it is found once a text
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", tx.doc_type(F.col("text")).alias("kind"))
    docs = docs.select("doc_id", tx.analyze(F.col("text"), F.col("kind")).alias("r"))
    return docs.select("doc_id", F.col("r.error").isNotNull().alias("is_error"), "r.*")


def txt_7_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tx.general(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", *_fields(r, "title summary"), *_fields(r["length"], "characters words lines"))


def txt_13_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_lines(F.col("text")).alias("cleaned"), tx.ink(F.col("text")).alias("ink"))


def srt_12_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(text, 1, 100).alias("head"), tx.truncated(text, 200).alias("preview"), tx.truncated(text, 500).alias("excerpt"))


def txt_11_structured_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rendered(spark, sf_dir, "customer", K, NOTE).select(K, ocr.structured_info(F.col("text")).alias("r"))
    return r.select(K, *[F.array_join(f"r.{n}", "|").alias(n) for n in ocr.FIELDS])


def agg_2_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many dates, addresses and so on a note has."""
    notes = _rendered(spark, sf_dir, "customer", K, f"case when {K} % 3 = 0 then {DATE} when {K} % 3 = 1 then {NOTE} else 'nothing' end")
    return notes.select(K, ocr.n_items(ocr.structured_info(F.col("text"))).alias("n_items"))


def txt_10_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of receipts, cards, id cards, forms and other texts, by the type named (odd keys) or
    the type found: what the type's record says first."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(SAID).alias("text"), F.expr("case o_orderkey % 12 when 1 then 'form' when 7 then 'letter' end").alias("named"))
    orders = orders.select("o_orderkey", "text", F.coalesce("named", tx.doc_type(F.col("text"))).alias("kind"))
    text, kind = F.col("text"), F.col("kind")
    first = tx.field_of(text, kind, {"receipt": "merchant", "business_card": "name", "id_card": "id_number", "form": "title", "text_document": "title"})
    blank = tx.is_blank(text)
    return orders.select(
        "o_orderkey", F.when(blank, "Empty text").alias("error"), tx.record_type(text, kind).alias("type"), first.alias("first"),
        F.when(~blank, F.size(tx.entities(text))).cast("long").alias("entities"))


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_S = STRIP.format
SQL = {
    "txt_1_entities": " union all ".join(
        f"select {K}, '{n}' as entity, {e} as value from customer" for n, e in
        (("email", EMAIL), ("phone", PHONE), ("date", DATE), ("time", TIME), ("url", URL), ("price", PRICE), ("credit_card", CARD), ("ssn", SSN), ("address", "'12 Elm Street, Town'"))
    ) + f" union all select {K}, 'zip_code', cast({K} as varchar) from customer where {K} between 10000 and 99999",
    "txt_2_doc_type": f"select o_orderkey, {TYPE_OF} as doc_type from orders",
    "agg_3_type_distribution": f"select doc_type, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from (select {TYPE_OF} as doc_type from orders) group by 1",
    "txt_3_receipt": f"select o_orderkey, {SHOP} as merchant, {DAY} as date, concat('09:', {pad('o_orderkey % 60', 2)}, ' AM') as time, cast({cents(13)} as double) as total, "
    f"cast({cents(13)} as double) as subtotal, cast({cents(17)} as double) as tax, case o_orderkey % 3 when 0 then 'visa' when 1 then 'cash' end as payment_method from orders",
    "txt_3_receipt_items": " union all ".join(
        f"select o_orderkey, o_orderkey % {m} + 1 as quantity, '{d}' as description, cast({cents(a)} as double) as price, round((o_orderkey % {m} + 1) * cast({cents(a)} as double), 4) as subtotal from orders"
        for m, d, a in ((5, "widget", 7), (3, "gadget", 11))
    )
    # the pattern also takes the cents of the subtotal and the tax line after it for an item
    + f" union all select o_orderkey, o_orderkey * 13 % 100, 'Tax:', cast({cents(17)} as double), round((o_orderkey * 13 % 100) * cast({cents(17)} as double), 4) from orders",
    "txt_4_business_card": f"select {K}, concat('Person ', {K}) as name, 'Manager' as title, '' as company, {PHONE} as phone, '(999) 111-2222' as mobile, {EMAIL} as email, case when {K} % 2 = 0 then {URL} else 'www.acme.example.com' end as website, {HOME.format(K)} as address from customer",
    "txt_5_id_card": f"select s_suppkey, concat('S', s_suppkey) as id_number, s_name as name, concat('02/', {pad('s_suppkey % 28 + 1', 2)}, '/1980') as date_of_birth, '03/04/2020' as issue_date, concat('03/', {pad('s_suppkey % 28 + 1', 2)}, '/2030') as expiration_date, {HOME.format('s_suppkey')} as address from supplier",
    "txt_6_form_fields": "select o_orderkey, 'Request!' as title, true as signature, 'zip' as field, cast(o_orderkey as varchar) as value from orders "
    "union all select o_orderkey, 'Request!', true, 'city', concat('last ', o_orderkey % 3) from orders",
    "txt_8_key_values": "select o_orderkey, unnest(['alpha', 'beta', 'gamma']) as field, unnest([concat('a', o_orderkey), 'b', concat('g ', o_orderkey % 5)]) as value from orders",
    "txt_9_redact": f"select {K}, concat('Contact ', {EMAIL}, ' or (', {pad(f'{K} % 900 + 100', 3)}, 'XXX-XXXX on ', {DATE}, ' at {{', {TIME}, '}}. Site ', {URL}, ' costs ', {PRICE}, ' number [REDACTED CARD] ssn [REDACTED SSN] end; 12 Elm Street, Town') as redacted from customer",
    "txt_7_general": f"""with t as (select doc_id, coalesce(text, '') as text, {_S("coalesce(text, '')")} as s from documents), l as (select *, string_split(s, chr(10)) as ls from t)
      select doc_id, {_S('ls[1]')} as title, length(text) as characters, len(regexp_extract_all(text, '\\S+')) as words, len(ls) as lines,
      case when {_S('ls[1]')} <> '' and len(ls) > 1 then {_S('ls[2]')} else {_S('text[1:100]')} end as summary from l""",
    "txt_13_clean_lines": f"select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_S('x')}), lambda x: x <> ''), chr(10)) as cleaned, length(replace(replace(text, ' ', ''), chr(10), '')) as ink from documents",
    "srt_12_truncated": "select doc_id, text[1:100] as head, case when length(text) > 200 then concat(text[1:200], '...') else text end as preview, case when length(text) > 500 then concat(text[1:500], '...') else text end as excerpt from documents",
    "txt_11_structured_info": f"select {K}, concat({DATE}, '|23-45-', {pad(f'{K} % 10000', 4)}) as dates, {EMAIL} as emails, substr({PHONE}, 2) as phones, '12 Elm Street' as addresses, {PRICE} as amounts from customer",
    "agg_2_items": f"select {K}, cast(case {K} % 3 when 0 then 1 when 1 then 6 else 0 end as bigint) as n_items from customer",
    "txt_10_dispatch": f"""select o_orderkey, case when o_orderkey % 6 = 5 then 'Empty text' end as error,
      case o_orderkey % 6 when 0 then 'receipt' when 1 then if(o_orderkey % 12 = 1, 'form', 'text_document') when 2 then 'text_document' when 3 then 'business_card' when 4 then 'id_card' end as type,
      case o_orderkey % 6 when 0 then {SHOP} when 1 then 'Request!' when 2 then concat('chapter ', o_orderkey, ' figure') when 3 then concat('Person ', o_orderkey) when 4 then concat('N', o_orderkey) end as first,
      cast(case when o_orderkey % 6 = 5 then null when o_orderkey % 6 = 0 then 3 when o_orderkey % 6 in (1, 2, 3) then if(o_orderkey between 10000 and 99999, 1, 0) else 0 end as bigint) as entities from orders""",
}
QUERIES = {f.__name__: f for f in (
    txt_1_entities, txt_2_doc_type, txt_3_receipt, txt_3_receipt_items, txt_4_business_card, txt_5_id_card, txt_6_form_fields, txt_7_general, txt_8_key_values,
    txt_9_redact, txt_10_analyze, txt_10_dispatch, agg_2_items, txt_11_structured_info, txt_13_clean_lines, srt_12_truncated,
)} | {"agg_3_type_distribution": doc_type_distribution}
