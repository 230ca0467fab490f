"""Shapes of the working tables. The long `claims` table, one row per claim, is the centre."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where a row stood in reading order: Spark rows have none, and "the first one wins" needs it.
ORDER = ["stage_ord", "page_ord", "item_ord"]

RAW_FACT = {
    "org_number": "string", "stage_ord": "int", "page_ord": "bigint", "item_ord": "bigint", "field": "string",
    "value": "string", "source_url": "string", "extraction_method": "string", "extracted_at": "timestamp",
    "content_hash": "string", "linked_from": "string", "context_name": "string", "evidence_span": "string",
    "effective_date": "string",
}
CONFIRMED_FACT = {
    "org_number": "string", "stage_ord": "int", "page_ord": "bigint", "item_ord": "bigint", "field": "string",
    "value": "string", "source_url": "string", "match_confidence": "double", "retrieved_at": "timestamp",
    "reporting_period": "string", "content_hash": "string", "extraction_method": "string", "source_class": "string",
    "linked_from": "string", "effective_date": "string", "evidence_span": "string",
}
CLAIM = {
    "org_number": "string", "field": "string", "stage_ord": "int", "page_ord": "bigint", "item_ord": "bigint",
    "value": "string", "state": "string", "source": "string", "retrieved_at": "timestamp", "reporting_period": "string",
    "content_hash": "string", "source_class": "string", "extraction_method": "string", "match_confidence": "double",
    "linked_from": "string", "effective_date": "string", "evidence_span": "string", "reason": "string",
}
PAGE = (
    "org_number string, page_ord bigint, url string, raw_html string, fetched_at timestamp, fetch_state string, "
    "linked_from string, final_url string, rendered boolean"
)
RESPONSE = "org_number string, kind string, page_no int, url string, status int, body string, retrieved_at timestamp"
UNIVERSE = (
    "organisation_number string, name string, website string, municipality string, industry_code string, "
    "industry_label string, employees int, legal_form string, bankrupt boolean, liquidating boolean"
)
ADDRESS = "struct<adresse:array<string>,postnummer:string,poststed:string,kommune:string>"
ENTITY_RECORD = (
    "navn string, organisasjonsform struct<kode:string,beskrivelse:string>, "
    "historiskeNavn array<struct<navn:string,fraDato:string,tilDato:string>>, hjemmeside string, epostadresse string, "
    f"telefon string, mobil string, forretningsadresse {ADDRESS}, postadresse {ADDRESS}, "
    "naeringskode1 struct<kode:string,beskrivelse:string>, antallAnsatte int, "
    "registreringsdatoAntallAnsatteEnhetsregisteret string, stiftelsesdato string, konkurs boolean, "
    "underAvvikling boolean, underTvangsavviklingEllerTvangsopplosning boolean, aktivitet array<string>, "
    "vedtektsfestetFormaal array<string>"
)
# Holders carry a name and a role only: birth dates are never read, so they cannot be published.
ROLES_RECORD = (
    "rollegrupper array<struct<type:struct<kode:string,beskrivelse:string>,sistEndret:string,roller:array<struct<"
    "type:struct<kode:string,beskrivelse:string>,"
    "person:struct<navn:struct<fornavn:string,mellomnavn:string,etternavn:string>,erDoed:boolean>,"
    "enhet:struct<organisasjonsnummer:string,navn:array<string>,erSlettet:boolean>,"
    "avregistrert:boolean,fratraadt:boolean>>>>"
)
SUBUNITS_RECORD = (
    "_embedded struct<underenheter:array<struct<organisasjonsnummer:string,navn:string,antallAnsatte:int,"
    f"beliggenhetsadresse:{ADDRESS},postadresse:{ADDRESS},_links:struct<self:struct<href:string>>>>>"
)
UPDATES_RECORD = "_embedded struct<oppdaterteEnheter:array<struct<dato:string,endringstype:string>>>"
FEED_PAGE = "items array<struct<id:string,url:string,_feed_entry:struct<status:string,businessName:string>>>, next_url string"
# Contact people of an ad are not in this schema either.
AD_RECORD = (
    "ad_content struct<title:string,published:string,expires:string,employer:struct<orgnr:string,homepage:string>>"
)
POST_LIST = "array<struct<date:string,title:struct<rendered:string>,link:string>>"


def conform(df: DataFrame, shape: dict[str, str], **given: Column) -> DataFrame:
    """`df` in a working shape: given columns, then columns of the same name, then NULL."""
    columns = []
    for name, kind in shape.items():
        if name in given:
            columns.append(given[name].cast(kind).alias(name))
        elif name in df.columns:
            columns.append(F.col(name).cast(kind).alias(name))
        else:
            columns.append(F.lit(None).cast(kind).alias(name))
    return df.select(*columns)
