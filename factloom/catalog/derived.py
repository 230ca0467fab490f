"""Inputs that Spark derives from the given tables, one row per row of theirs, so every query over them grows
with the data: companies, registry responses, filings, job ads and company pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.catalog.registry import table

READ_AT = "2024-06-01 00:00:00"
TASK_ROWS = 2_500  # of companies, whose pages and records take milliseconds each
TASK_FILINGS = 25_000


def words(*parts) -> Column:
    """Literals and columns joined into one string."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def spread(rows: DataFrame, count: int, task_rows: int) -> DataFrame:
    """`rows` dealt over tasks of about `task_rows`. Spark sizes its tasks by the bytes they read, and a few bytes of key become
    kilobytes of markup or JSON: without this, one task would derive and read the pages of a whole table. The rows come out of a
    generator, below which Catalyst moves no filter: one on what is read from a record would read it in the few tasks before."""
    tasks = -(-count // task_rows)
    return rows.repartition(tasks).select(F.inline_outer(F.array(F.struct(*rows.columns)))) if tasks > 1 else rows


def companies(spark: SparkSession, sf: str) -> DataFrame:
    """One company per customer, named after the part of the same number; names repeat heavily."""
    key = F.col("c_custkey")
    form = F.element_at(F.array(*[F.lit(f) for f in ("AS", "ASA", "ENK", "NUF")]), (key % 4 + 1).cast("int"))
    customers = table(spark, sf, "customer")
    joined = customers.join(table(spark, sf, "part"), key == F.col("p_partkey")).select("c_custkey", "p_name", "c_mktsegment", "c_acctbal")
    return spread(joined, customers.count(), TASK_ROWS).select(
        "c_custkey", (F.lit(900000000) + key).cast("string").alias("org_number"), "p_name", F.concat(F.upper("p_name"), F.lit(" "), form).alias("legal_name"),
        form.alias("legal_form"), F.when(key % 5 != 0, F.concat(F.lit("www."), F.replace("p_name", F.lit(" "), F.lit("")), F.lit(".no"))).alias("website"),
        F.when(key % 7 == 0, F.lit("firma@gmail.com")).otherwise(F.concat(F.lit("post@mail."), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".no"))).alias("email"),
        F.col("c_mktsegment").alias("town"), "c_acctbal", (key % 50).alias("employees"),
    )


def _response(rows: DataFrame, kind: str, url: Column, status: Column, body: Column, page_no: Column | None = None) -> DataFrame:
    return rows.select(
        "org_number", F.lit(kind).alias("kind"), (F.lit(1) if page_no is None else page_no).alias("page_no"), url.alias("url"), status.cast("int").alias("status"),
        F.when(status == 200, body).alias("body"), F.lit(READ_AT).cast("timestamp").alias("retrieved_at"),
    )


def entity_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One stored entity record per company; some missing, some failed, some with two current names."""
    c = companies(spark, sf)
    key = F.col("c_custkey")

    def former(name: Column, until: Column) -> Column:
        return F.struct(name.alias("navn"), F.lit("1990-01-01").alias("fraDato"), until.alias("tilDato"))

    until = F.concat((key % 20 + 2000).cast("string"), F.lit("-05-0"), (key % 9 + 1).cast("string"))
    none = F.lit(None).cast("string")
    history = F.array(
        former(F.concat(F.lit("OLD "), "legal_name"), until), former(F.col("legal_name"), F.lit("1999-01-01")),
        former(F.lit("SECOND NAME AS"), F.when(key % 23 == 0, none).otherwise(F.lit("1995-02-03"))),
        former(F.lit("FIRST NAME AS"), F.when(key % 23 == 0, none).otherwise(F.lit("1992-02-03"))),
    )
    address = F.struct(
        F.array(F.concat(F.lit("Storgata "), key.cast("string"))).alias("adresse"), F.lpad((key % 10000).cast("string"), 4, "0").alias("postnummer"),
        F.col("town").alias("poststed"), F.col("town").alias("kommune"),
    )
    body = F.to_json(F.struct(
        F.col("org_number").alias("organisasjonsnummer"), F.col("legal_name").alias("navn"),
        F.struct(F.col("legal_form").alias("kode"), F.lit("form").alias("beskrivelse")).alias("organisasjonsform"), history.alias("historiskeNavn"),
        F.col("website").alias("hjemmeside"), F.col("email").alias("epostadresse"), F.concat(F.lit("22 33 "), F.lpad((key % 10000).cast("string"), 4, "0")).alias("telefon"),
        address.alias("forretningsadresse"), F.struct(F.lit("62.010").alias("kode"), F.concat(F.lit("Trade in "), "p_name").alias("beskrivelse")).alias("naeringskode1"),
        F.when(key % 11 != 0, F.col("employees")).alias("antallAnsatte"), F.concat((key % 24 + 1990).cast("string"), F.lit("-03-15")).alias("stiftelsesdato"),
        F.when(key % 13 != 0, F.col("c_acctbal") < -900).alias("konkurs"), F.when(key % 13 != 0, F.col("c_acctbal") < -500).alias("underAvvikling"),
        F.when(key % 3 == 0, F.array(F.concat(F.lit("Production of "), "p_name"), F.lit("and related services"))).alias("aktivitet"),
        F.array(F.concat(F.lit("The purpose is trade in "), "p_name")).alias("vedtektsfestetFormaal"),
    ))
    status = F.when(key % 17 == 0, 404).when(key % 19 == 0, 500).otherwise(200)
    return _response(c, "entity", F.concat(F.lit("https://data.brreg.no/enhetsregisteret/api/enheter/"), "org_number"), status, body)


def role_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Three role groups per company: a director, a board with a resigned and a dead member, an auditor firm."""
    c = companies(spark, sf)
    key = F.col("c_custkey")
    no = F.lit(False)
    unit_type = "struct<organisasjonsnummer:string,navn:array<string>,erSlettet:boolean>"
    person_type = "struct<navn:struct<fornavn:string,mellomnavn:string,etternavn:string>,fodselsdato:string,erDoed:boolean>"

    def person(title: str, first: Column, last: Column, resigned: Column = no, dead: Column = no) -> Column:
        holder = F.struct(
            F.struct(first.alias("fornavn"), F.lit(None).cast("string").alias("mellomnavn"), last.alias("etternavn")).alias("navn"),
            F.lit("1970-01-01").alias("fodselsdato"), dead.alias("erDoed"),
        )
        return F.struct(
            F.struct(F.lit("X").alias("kode"), F.lit(title).alias("beskrivelse")).alias("type"), holder.alias("person"), F.lit(None).cast(unit_type).alias("enhet"),
            no.alias("avregistrert"), resigned.alias("fratraadt"),
        )

    def firm(title: str, number: Column, name: Column) -> Column:
        unit = F.struct(number.alias("organisasjonsnummer"), F.array(name).alias("navn"), no.alias("erSlettet"))
        return F.struct(
            F.struct(F.lit("X").alias("kode"), F.lit(title).alias("beskrivelse")).alias("type"), F.lit(None).cast(person_type).alias("person"), unit.alias("enhet"),
            no.alias("avregistrert"), no.alias("fratraadt"),
        )

    def group(code: str, day: Column, *roles: Column) -> Column:
        return F.struct(F.struct(F.lit(code).alias("kode"), F.lit(code).alias("beskrivelse")).alias("type"), day.alias("sistEndret"), F.array(*roles).alias("roller"))

    last = F.concat(F.lit("Hansen"), key.cast("string"))
    body = F.to_json(F.struct(F.array(
        group("DAGL", F.concat((key % 5 + 2020).cast("string"), F.lit("-02-01T10:00:00")), person("Daglig leder", F.lit("Kari"), last)),
        group("STYR", F.lit("2019-01-01"), person("Styrets leder", F.lit("Kari"), last), person("Styremedlem", F.lit("Ola"), last, key % 2 == 0), person(
            "Styremedlem", F.lit("Per"), last, no, key % 3 == 0)),
        group("REVI", F.lit("2018-01-01"), firm("Revisor", F.lit("999999999"), F.lit("REVISJON AS"))),
    ).alias("rollegrupper")))
    return _response(c, "roles", F.concat(F.lit("https://data.brreg.no/enhetsregisteret/api/enheter/"), "org_number", F.lit("/roller")), F.lit(200), body)


def accounts_responses(spark: SparkSession, sf: str) -> DataFrame:
    """One accounts list per order: last year's and this year's company filing, and a group filing. Figures come
    from the order; a missing figure, an empty list, a 404 and a 500 occur."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    o = spread(orders, orders.count(), TASK_FILINGS).withColumn("org_number", (F.lit(900000000) + F.col("o_orderkey")).cast("string"))
    key, price = F.col("o_orderkey"), F.round("o_totalprice", 0)
    year = F.year("o_orderdate")

    def filing(kind: str, period: Column, revenue: Column, result: Column) -> Column:
        return F.concat(
            F.lit('{"journalnr":"'), key.cast("string"), F.lit(f'","regnskapstype":"{kind}","valuta":"NOK","regnskapsperiode":{{"tilDato":"'), period.cast("string"),
            F.lit('-12-31"},"resultatregnskapResultat":{'), F.coalesce(F.concat(F.lit('"aarsresultat":'), result, F.lit(",")), F.lit("")),
            F.lit('"driftsresultat":{"driftsinntekter":{"sumDriftsinntekter":'), revenue, F.lit("}}}}"),
        )

    def whole(x: Column) -> Column:
        return x.cast("bigint").cast("string")

    result = F.when(key % 4 != 0, whole(price / 10 - 20000))
    body = F.when(key % 29 == 0, F.lit("[]")).otherwise(F.concat(
        F.lit("["), filing("SELSKAP", year - 1, whole(price / 2), result), F.lit(","), filing("KONSERN", year, whole(price * 3), result), F.lit(","),
        filing("SELSKAP", year, whole(price), result), F.lit("]"),
    ))
    status = F.when(key % 31 == 0, 404).when(key % 37 == 0, 500).otherwise(200)
    return _response(
        o, "accounts", F.concat(F.lit("https://data.brreg.no/regnskapsregisteret/regnskap/"), "org_number", F.lit("?regnskapstype=SELSKAP")), status, body
    )


def subunit_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Two pages of sub-units per company; every ninth list is empty, every thirteenth could not be read."""
    c = companies(spark, sf).withColumn("page_no", F.explode(F.array(F.lit(1), F.lit(2))))
    key, page = F.col("c_custkey"), F.col("page_no")
    number = (F.lit(800000000) + key * 2 + page - 1).cast("string")
    address = F.concat(
        F.lit('{"adresse":["Havnegata '), page.cast("string"), F.lit('"],"kommune":"'), F.col("town"), F.lit('","postnummer":"0150","poststed":"'), F.col("town"), F.lit('"}')
    )
    unit = F.concat(
        F.lit('{"organisasjonsnummer":"'), number, F.lit('","navn":"'), F.col("legal_name"), F.lit(' AVD '), page.cast("string"), F.lit('","antallAnsatte":'),
        F.col("employees").cast("string"), F.lit(',"beliggenhetsadresse":'), F.when(key % 4 == 0, F.concat(F.lit('{"kommune":"'), F.col("town"), F.lit('"}'))).otherwise(address),
        F.lit(',"_links":{"self":{"href":"https://data.brreg.no/enhetsregisteret/api/underenheter/'), number, F.lit('"}}}'),
    )
    body = F.when(key % 9 == 0, F.lit('{"_links":{}}')).otherwise(F.concat(F.lit('{"_embedded":{"underenheter":['), unit, F.lit("]}}")))
    return _response(
        c, "subunits", F.concat(F.lit("https://data.brreg.no/enhetsregisteret/api/underenheter?overordnetEnhet="), "org_number", F.lit("&page="), page.cast("string")),
        F.when(key % 13 == 0, 500).otherwise(200), body, page,
    )


def update_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Five dated registry updates per company."""
    c = companies(spark, sf)
    key = F.col("c_custkey")

    def event(n: int) -> Column:
        return F.concat(F.lit('{"dato":"20'), F.lpad((key % 13 + n).cast("string"), 2, "0"), F.lit(f'-0{n + 1}-10T08:00:00.000Z","endringstype":"'), F.when(
            key % 2 == 0, F.lit("Endring")).otherwise(F.lit("Ny")), F.lit('"}'))

    body = F.concat(F.lit('{"_embedded":{"oppdaterteEnheter":['), F.array_join(F.array(*[event(n) for n in range(5)]), ","), F.lit("]}}"))
    return _response(c, "updates", F.concat(F.lit("https://data.brreg.no/enhetsregisteret/api/oppdateringer/enheter?organisasjonsnummer="), "org_number"), F.lit(200), body)


def company_pages(spark: SparkSession, sf: str, html: Column, path: Column, rows: DataFrame | None = None) -> DataFrame:
    """One page per company on its own domain, with the given markup; columns of `companies` may be used."""
    c = companies(spark, sf) if rows is None else rows
    return c.select(
        "org_number", F.lit(0).cast("bigint").alias("page_ord"), F.concat(F.lit("https://"), F.replace("p_name", F.lit(" "), F.lit("")), F.lit(".no"), path).alias("url"),
        html.alias("raw_html"), F.lit(READ_AT).cast("timestamp").alias("fetched_at"), F.lit("available").alias("fetch_state"),
        F.lit(None).cast("string").alias("linked_from"), F.lit(None).cast("string").alias("final_url"), F.lit(False).alias("rendered"),
        "c_custkey", "legal_name", "p_name",
    )


def claims_of_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as claims: user = entity, event type = field, the integer part of the value = value."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").cast("string").alias("org_number"), F.col("event_type").alias("field"), F.col("event_id"), F.floor("value").cast("string").alias("value"),
        F.date_format("ts", "yyyy-MM-dd").alias("period"), "ts", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
