"""Declared schemas: listings, brokers, lead documents, leads, attempts, evidence, report."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B, TS = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, S) for n in names])


STRINGS = T.ArrayType(S)

BROKER = struct(id=S, email=S, broker_name=S, created_at=TS, updated_at=TS)

LISTING = struct(
    id=S, nom_bateau=S, constructeur=S, longueur_m=T.DecimalType(10, 2), annee=I,
    proprietaire=S, capitaine=S, broker_id=S, localisation=S, etoile=B, nombre_cabines=I,
    prix_actuel=S, prix_precedent=S, dernier_message=S, commentaire=S, image_url=S,
    created_at=TS, updated_at=TS, external_id=S,
)

# header of the listings CSV -> canonical column
LISTING_CSV = {
    "Nom du Bateau": "nom_bateau", "Constructeur": "constructeur",
    "Longueur (M/pieds)": "longueur_m", "Année": "annee", "Propriétaire": "proprietaire",
    "Capitaine": "capitaine", "Broker": "broker", "Localisation": "localisation",
    "Prix Actuel (€/$)": "prix_actuel", "Prix Précédent (€/$)": "prix_precedent",
    "Date de la dernière relance": "derniere_relance", "Dernier message": "dernier_message",
    "Commentaire": "commentaire", "Broker 2": "broker_2", "Broker 3": "broker_3",
    "Broker 4": "broker_4",
}

LEAD_DOCUMENT = struct(
    lead=strings("id", "date", "source", "detailedSource", "detailedSourceSummary", "requestType"),
    contact=struct(
        name=strings("display", "first", "last"), phone=S, email=S, country=S, postalCode=S),
    customerComments=S,
    leadComments=S,
    boat=struct(
        make=S, model=S, year=S, hin=S, condition=S, classCode=S, name=S, stockNumber=S, imtId=S,
        length=strings("measure", "units"),
        location=strings("city", "stateProvince", "country", "postalCode"),
        price=strings("amount", "currency"), url=S),
    recipient=strings("officeName", "officeId", "contactName"),
    leadSmart=struct(leadHistory=T.ArrayType(struct(
        make=S, model=S, year=S, dateOfLead=S, portalName=S,
        location=strings("city", "country", "stateProvince")))),
)

QUERY_INPUT = strings("full_name", "email", "company_name", "country", "city")

ATTEMPT = struct(
    id=S, lead_id=S, status=S, trigger_source=S, engine=S, schema_version=S,
    query_input=QUERY_INPUT, report=S, error_code=S, error_message=S, retry_count=I,
    requested_at=TS, started_at=TS, completed_at=TS, checked_at=TS, created_at=TS, updated_at=TS,
)

DOCUMENT = struct(lead_id=S, ordinal=T.LongType(), url=S, text=S, source_type=S)
HIT = struct(lead_id=S, ordinal=T.LongType(), url=S, title=S, content=S)

SCREENING = struct(status=S, details=STRINGS)
MATCHED_PERSON = struct(name=S, headline=S, location=S, company=S, evidence=STRINGS)
ADVERSE_ITEM = strings(
    "category", "title", "summary", "date", "jurisdiction", "confidence", "status_type",
    "source_url")
VESSEL = strings(
    "vessel_name", "imo", "mmsi", "flag", "registered_owner", "beneficial_owner", "manager",
    "builder", "year_built", "source_url")
SOURCE = strings("type", "url", "note")
FINANCIALS = strings("revenue", "net_income", "employees", "share_capital", "currency", "year")
COMPANY = struct(
    company_name=S, legal_form=S, status=S, jurisdiction=S, registration_number=S, vat_number=S,
    lei=S, incorporation_date=S, address=S, industry=S, directors=STRINGS, shareholders=STRINGS,
    ubo=STRINGS, subsidiaries=STRINGS, financials=FINANCIALS, website=S)

REPORT = struct(
    query_input=QUERY_INPUT,
    identity_resolution=struct(
        status=S, confidence_score=I, matched_persons=T.ArrayType(MATCHED_PERSON),
        selected_profile_rationale=S),
    person_profile=struct(
        full_name=S, aliases=STRINGS, current_title=S, current_company=S, location=S, country=S,
        emails=STRINGS, phones=STRINGS, websites=STRINGS,
        profiles=struct(linkedin=S, company_profile=S, other=STRINGS)),
    company_profile=COMPANY,
    risk_screening=struct(
        sanctions=SCREENING, pep=SCREENING, watchlists=SCREENING, offshore_leaks=SCREENING),
    adverse_media=T.ArrayType(ADVERSE_ITEM),
    maritime_screening=struct(status=S, assets=T.ArrayType(VESSEL)),
    economic_coherence=struct(level=S, indicators=STRINGS),
    kyc_assessment=struct(
        overall_risk=S, recommended_review=S, executive_summary=STRINGS, key_reasons=STRINGS,
        missing_critical_items=STRINGS),
    sources=T.ArrayType(SOURCE),
)

# provider records
PROFILE_ITEM = struct(
    name=S, firstName=S, lastName=S, headline=S, position=S, about=S,
    location=struct(linkedinText=S, parsed=struct(text=S)),
    currentPosition=T.ArrayType(strings("position", "companyName", "description", "companyLinkedinUrl")),
    linkedinUrl=S)
COMPANY_ITEM = struct(
    name=S, website=S, industries=T.ArrayType(strings("name")),
    locations=T.ArrayType(strings("line1", "line2", "city", "geographicArea", "country")),
    foundedOn=struct(year=S), companyType=S, employeeCount=T.LongType())
ADVERSE_RECORD = struct(
    country=S,
    hits=T.ArrayType(strings(
        "title", "url", "publishedDate", "snippet", "riskCategory", "severity", "entityRole",
        "entityMatchConfidence")))
