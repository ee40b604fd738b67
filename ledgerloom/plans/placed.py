"""Registered queries of places and organisations, over documents that have an invented sender's address in their names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import places as P
from ledgerloom.plans import fixtures as fx
from ledgerloom.plans import gazetteer as G
from ledgerloom.plans.registered import query, values

#: An address of a document, the same in Spark SQL and in DuckDB.
ADDRESS = """case doc_id % 12
 when 0 then 'Eschenstrasse 7, 1112 Lindau an der Furt' when 1 then 'Landgericht Steg, Verfügung' when 2 then 'Fach 1234 Steg'
 when 3 then 'über den Steg nach Bern' when 4 then 'Furt Bank, Uferweg 1, 1100 Steg' when 5 then 'Botenpost AG, 3030 Bern'
 when 6 then 'Steg, den 3. Mai' when 7 then 'Hohl am Rain' when 8 then 'Quellwerk Erlen AG' when 9 then concat('20', lpad(cast(doc_id % 100 as string), 2, '0'), ' Tannstadt')
 when 10 then 'am Steg entlang in Birkau, Steger Seite' else 'ohne Ort' end"""

_EDGE = r"[\p{L}\p{N}_]"
_PLACES = [(geo, parent or "", name) for geo, parent, name, _ in G.PLACES]


def _says(term: str) -> str:
    between = r"[^\p{L}\p{N}_]+".join(term.split())
    return f"regexp_matches(t, '(?:^|[^\\p{{L}}\\p{{N}}_]){between}(?:$|[^\\p{{L}}\\p{{N}}_])')"


def _named(rows) -> str:
    return " union ".join(f"select doc_id, '{r[0]}' id from d where {_says('(?:' + '|'.join(t for t in r[-1] if ' ' not in t) + ')') if any(' ' not in t for t in r[-1]) else 'false'}" + "".join(f" or {_says(t)}" for t in r[-1] if " " in t) for r in rows if r[-1])


_NAME, _ADJECTIVE, _REGION, _TOWN, _IDIOMS, _OF_REGION, _OF_TOWN = G.AMBIGUOUS[0]
_IDIOM = _IDIOMS
_DOCS = f"d as (select doc_id, lower(concat_ws(' ', {ADDRESS}, text)) t from documents)"
_GEO = (
    f"p(geo_id, parent, \"name\") as (values {values(_PLACES)}), own as ({_named(G.PLACES)}), z as (select * from d where {_says(_NAME)} and not regexp_matches(t, '{_IDIOM}')), "
    f"f as (select doc_id, id geo_id, 1.0 c from own union all select doc_id, parent, 0.95 from own join p on id = geo_id union all select doc_id, '{_REGION}', 0.9 from d where {_says(_ADJECTIVE)} "
    f"union all select doc_id, '{_REGION}', case when regexp_matches(t, '{_OF_REGION}') then 1.0 when regexp_matches(t, '{_OF_TOWN}') then 0.95 else 0.85 end from z "
    f"union all select doc_id, '{_TOWN}', 1.0 from z where regexp_matches(t, '{_OF_TOWN}') and not regexp_matches(t, '{_OF_REGION}')), geo as (select doc_id, geo_id, max(c)::double confidence from f group by all)"
)
_ORG = f"o(org_id, \"name\", seat, jurisdiction) as (values {values([r[:4] for r in G.ORGANISATIONS])}), org as (select doc_id, id org_id, 1.0::double confidence from ({_named(G.ORGANISATIONS)}))"


def _docs(spark, sf):
    return fx.table(spark, sf, "documents").withColumn("filename", F.expr(ADDRESS))


def _geo(spark, sf):
    return P.place_links(_docs(spark, sf), P.place_table(spark, G.PLACES), P.term_table(spark, G.PLACES), G.AMBIGUOUS)


def _org(spark, sf):
    return P.organisation_links(_docs(spark, sf), P.term_table(spark, G.ORGANISATIONS))


@query(f"with {_DOCS}, {_GEO} select * from geo")
def place_links(spark, sf):
    return _geo(spark, sf)


@query(f"with {_DOCS}, {_ORG} select * from org")
def organisation_links(spark, sf):
    return _org(spark, sf)


_AT = "'location_' || lower(replace({}, '-', '_'))"


@query(
    f"with {_DOCS}, {_GEO}, {_ORG} select {_AT.format('geo_id')} src, {_AT.format('parent')} dst, 'PART_OF_CANTON' relation, 2.0::double weight from p where parent <> '' "
    f"union all select 'organization_' || org_id, {_AT.format('seat')}, 'HEADQUARTERED_IN', 2.0 from o union all select 'organization_' || org_id, {_AT.format('jurisdiction')}, 'LOCATED_IN', 1.8 from o "
    f"union all select 'doc_' || doc_id, {_AT.format('geo_id')}, 'LOCATED_IN', confidence from geo union all select 'doc_' || doc_id, 'organization_' || org_id, 'MENTIONS_ORG', confidence from org"
)
def place_edges(spark, sf):
    return P.place_graph(P.place_table(spark, G.PLACES), P.organisation_table(spark, G.ORGANISATIONS), _geo(spark, sf), _org(spark, sf))[1]
