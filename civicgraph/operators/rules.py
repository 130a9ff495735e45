"""Benefit rules, rights, stories, documents, protocols and action plans."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_even
from ..functions.text import literal, lookup, quote
from .lookup import TYPE_EXPANSION

# ---- Fixed values: eligibility ------------------------------------------

POVERTY = {1: 15060, 2: 20440, 3: 25820, 4: 31200, 5: 36580, 6: 41960, 7: 47340, 8: 52720}
POVERTY_EXTRA = 5380
SNAP_MAX = {1: 292, 2: 536, 3: 768, 4: 975, 5: 1158, 6: 1390, 7: 1536, 8: 1756}
SNAP_EXTRA = 220
CASH = {1: 181, 2: 285, 3: 394, 4: 503, 5: 612, 6: 721}
CASH_DEFAULT = 721
# key -> name, documents, where to apply, how long
PROGRAMS = {
    "snap": ("SNAP (Food Stamps)", ["ID or document request form", "Proof of income", "Social Security numbers"],
             "HRA Benefits Access Center", "30 days (7 days for emergency)"),
    "medicaid": ("Medicaid (Health Insurance)", ["ID or document request form", "Proof of income", "Proof of NY residence"],
                 "HRA Medicaid Office or NY State of Health", "45 days (24 hours emergency Medicaid)"),
    "wic": ("WIC (Nutrition for families)", ["ID", "Proof of income", "Proof of residence", "Child's immunization record"],
            "Any WIC center (NYC Dept of Health)", "Same day enrollment possible"),
    "cash_assistance": ("Cash Assistance (NY Safety Net)", ["ID", "Proof of income", "SSN", "Proof of housing costs"],
                        "HRA Job Center", "30 days (7 days emergency)"),
    "school_meals": ("Free School Meals", ["School enrollment"], "Your child's school", "Immediate"),
    "emergency_shelter": ("Emergency Shelter (Right to Shelter)", ["None required initially — ID helpful but not mandatory"],
                          "PATH (151 E 151st St, Bronx) for families, Drop-in centers for singles",
                          "Same day placement guaranteed"),
    "fair_fares": ("Fair Fares NYC (50% off MetroCard)", ["ID", "Proof of income", "Proof of NYC residence"],
                   "HRA Benefits Center or fair.fares.nyc", "7 days"),
    "document_assistance": ("Emergency ID / Documents", ["What you have — they'll help with the rest"],
                            "HRA Benefits Center", "2-4 weeks for documents, same day for forms"),
}
# What is stated instead of an amount, when the program is open to them.
ESTIMATE_TEXT = {
    "medicaid": "Free health coverage", "wic": "~$55 food vouchers + formula",
    "school_meals": "Free breakfast + lunch for every school day",
    "emergency_shelter": "Free shelter for as long as needed", "fair_fares": "~$75/month savings",
    "document_assistance": "Free replacement IDs",
}

# ---- Fixed values: rights and stories -----------------------------------

RIGHTS = {
    "shelter": [
        ("Right to Shelter", "NYC legally must provide shelter to anyone who qualifies. You cannot be turned away."),
        ("Families stay together", "Shelters cannot separate parents from their children."),
        ("Pets are allowed", "Since 2023, NYC shelters must accommodate pets (some restrictions apply)."),
        ("No ID required initially", "You can enter shelter without ID. Staff will help you get one."),
        ("Leave anytime", "You are not required to stay. You can leave for any reason."),
        ("Religious protections", "Shelters must respect your religious practices (diet, clothing, prayer)."),
        ("Language access", "You have the right to translation services in 10+ languages."),
    ],
    "food_bank": [
        ("No proof of income needed", "Most food pantries don't require income verification."),
        ("Culturally appropriate food", "Large pantries offer halal, kosher, and vegetarian options."),
        ("Emergency food same-day", "You can get food the same day you arrive, no appointment needed."),
        ("No citizenship check", "Food pantries do not check immigration status."),
    ],
    "hospital": [
        ("Emergency care cannot be denied", "EMTALA law: hospitals MUST treat emergencies regardless of ability to pay or immigration status."),
        ("Financial assistance", "NYC hospitals offer sliding-scale fees based on income."),
        ("Language interpreters", "Free interpretation in 100+ languages — you can request it."),
        ("Your records are private", "HIPAA protects your info — it cannot be shared with ICE or other agencies."),
    ],
    "school": [
        ("Free education for all children", "ALL kids ages 5-21 can attend NYC public school regardless of immigration status or housing situation."),
        ("No address needed", "Homeless children can enroll WITHOUT a permanent address (McKinney-Vento Act)."),
        ("Free meals", "Every NYC public school student gets free breakfast and lunch."),
        ("Free MetroCards", "Students get free MetroCards to travel to school."),
        ("Language support", "ELL (English Language Learner) programs available."),
    ],
    "benefits_center": [
        ("Apply without ID", "You can apply for benefits without ID using a 'Request for Proof' form. Staff will help you get ID."),
        ("Emergency SNAP in 7 days", "If you have < $150/month in cash and rent+utilities > monthly income, you qualify for expedited SNAP in 7 days."),
        ("Language assistance", "Free translation in person and over the phone."),
        ("Denial appeal", "If denied, you have 60 days to appeal. Free lawyers can help."),
        ("Confidentiality", "Your info cannot be shared with ICE or used against you for benefits you already received."),
    ],
    "domestic_violence": [
        ("Confidential location", "DV shelter addresses are not public for your safety."),
        ("No immigration consequences", "Immigration status doesn't affect your access to DV services."),
        ("Free legal help", "Free lawyers for orders of protection, custody, divorce."),
        ("Emergency U-visa", "DV victims may qualify for U-visa to legalize immigration status."),
    ],
    "default": [
        ("Translation services", "Free interpretation in 10+ languages at all city services."),
        ("File a complaint", "If you're treated unfairly, call 311 or contact the NYC Commission on Human Rights."),
        ("Your info is protected", "NYC agencies cannot share your info with ICE or immigration enforcement."),
    ],
}
# id, needs, timeframe, name, age range, situation, outcome, quote
STORIES = [
    ("maria-housing", ["housing", "benefits", "school"], "1 week from crisis to stable", "Maria", "30s",
     "Single mom, 2 kids, evicted from Brooklyn apartment",
     "Placed in family shelter in 2 days. Kids continued school. Got SNAP and Medicaid within a week.",
     "I thought I had to figure it out alone. I didn't."),
    ("james-reentry", ["housing", "documents", "employment"], "30 days to housing + ID + job plan", "James", "40s",
     "Just released from prison, no ID, no money, no family in NYC",
     "Moved into transitional housing same day. HRA got him new ID in 3 weeks. Started job training program.",
     "I didn't think anyone would help a guy like me. They did."),
    ("linh-newcomer", ["housing", "food", "healthcare", "language"], "2 weeks to full safety net", "Linh", "20s",
     "Recently arrived from Vietnam, limited English, 1 toddler",
     "Connected with Asian-American Family Services. Got WIC for toddler. Enrolled in ESL class. Found affordable apartment through HPD.",
     "They spoke Vietnamese. That was everything."),
    ("dolores-senior", ["benefits", "healthcare", "housing_assistance"], "3 weeks to all benefits enrolled", "Dolores", "70s",
     "Widow, fixed income, couldn't afford prescription + rent",
     "Qualified for SCRIE (Senior rent freeze). Got Medicare Extra Help for prescriptions. Meals on Wheels started weekly deliveries.",
     "I can pay rent and eat now. I forgot what that felt like."),
    ("ahmad-dv", ["safety", "housing", "legal", "immigration"], "24 hours to safety", "Ahmad", "30s",
     "Fleeing domestic abuse with young daughter, undocumented",
     "Moved to confidential DV shelter same night. Got free lawyer for U-visa application and order of protection. Daughter enrolled in school.",
     "Being undocumented didn't matter. Being safe did."),
    ("tina-family", ["housing", "healthcare", "benefits", "school"], "10 days to full stability", "Tina", "40s",
     "4 kids, lost job, sister kicking her out, diabetic child",
     "Emergency shelter that night. Pediatric diabetes clinic scheduled for son. SNAP + Medicaid approved in 10 days. Kids enrolled in nearest school.",
     "I was scared, but one step at a time made it possible."),
]
# (condition, right, detail) from the household profile
PROFILE_RIGHTS = [
    ("NOT has_id", "Apply without ID", "You can apply for benefits without ID using a 'Request for Proof' form at HRA. Staff will help you get documents."),
    ("is_undocumented", "Immigration status protected", "NYC agencies cannot share your information with ICE. You can use shelter, food, and healthcare regardless of status."),
    ("NOT has_insurance", "EMTALA — emergency care", "Hospitals must treat emergencies regardless of insurance. NYC Health + Hospitals offers sliding-scale care."),
    ("has_children", "School without address", "Children can enroll in NYC public school without a permanent address (McKinney-Vento Act). Free meals included."),
]

# ---- Fixed values: plans ------------------------------------------------

PRIORITY_ORDER = {
    "safety": 1, "domestic_violence": 1, "housing": 2, "shelter": 2, "medical": 3, "healthcare": 3,
    "health": 3, "food": 4, "benefits": 5, "documents": 5, "id": 5, "employment": 6, "job": 6,
    "school": 7, "education": 7, "childcare": 7, "legal": 8, "senior": 9,
}
TIME_FRAMES = {1: "URGENT — NOW", 2: "TONIGHT", 3: "TODAY / TOMORROW", 4: "THIS WEEK", 5: "THIS WEEK",
               6: "NEXT WEEK", 7: "NEXT 2 WEEKS", 8: "WHEN SETTLED", 9: "ONGOING"}

# ---- Fixed values: documents and protocols ------------------------------

# type -> (document, required, accepted substitutes, note)
DOCUMENTS = {
    "shelter": [
        ("Photo ID", True, ["birth certificate", "passport", "consular ID (Matricula)", "IDNYC card"],
         "DHS accepts a wide range of IDs; no ID should never block emergency shelter"),
        ("Social Security card or number", False,
         ["ITIN letter", "signed declaration of no SSN", "pending-application notice"],
         "Undocumented individuals may still access shelter — SSN not required for emergency intake")],
    "food_bank": [
        ("Proof of address (sometimes)", False,
         ["any mail with name", "caseworker letter", "verbal address", "hotel/motel confirmation"],
         "Most NYC food pantries do not require documents at all")],
    "hospital": [
        ("ID (any form)", False, ["verbal identification", "emergency waiver", "no ID required for emergency care"],
         "EMTALA mandates emergency treatment regardless of ID or insurance"),
        ("Insurance card", False, ["Medicaid number", "emergency Medicaid application on-site",
                                   "sliding-scale self-pay", "NYC Health + Hospitals financial counselor"],
         "NYC H+H hospitals offer financial counseling same-day")],
    "clinic": [
        ("ID", False, ["any photo ID", "letter from shelter", "utility bill", "verbal ID"],
         "Federally Qualified Health Centers (FQHCs) serve all regardless of documentation"),
        ("Proof of income or insurance", False,
         ["sliding-scale self-pay", "FHCC eligibility application", "Medicaid application"],
         "Income-based sliding scale available at most city clinics")],
    "benefits_center": [
        ("Photo ID", True, ["passport", "consular ID", "school ID + utility bill", "IDNYC"],
         "IDNYC is free for NYC residents and accepted for most benefits applications"),
        ("Proof of NYC address", True, ["shelter placement letter", "utility bill", "postmarked mail",
                                        "signed statement from landlord or host"],
         "Letter from shelter director is accepted at HRA offices"),
        ("Proof of income", True, ["pay stubs (2 most recent)", "employer letter", "zero-income declaration (signed)",
                                   "DHS shelter record as proof of homelessness"],
         "Zero-income declaration is legally accepted; no documents required to prove $0 income"),
        ("Social Security number", True, ["ITIN", "SSN application pending notice",
                                          "exempt — undocumented may apply for emergency benefits"],
         "Undocumented immigrants are eligible for emergency Medicaid and limited cash assistance")],
    "school": [
        ("Proof of age (birth certificate)", True, ["baptismal record", "passport", "hospital birth record",
                                                    "parent sworn statement (McKinney-Vento)"],
         "Under McKinney-Vento Act, homeless children must be enrolled immediately — documents can follow"),
        ("Immunization records", True, ["parent affidavit pending records", "conditional enrollment up to 30 days",
                                        "health center can provide records same-day"],
         "Conditional enrollment allows 30-day grace period under McKinney-Vento"),
        ("Proof of residency", False, ["shelter placement letter", "hotel/motel letter",
                                       "McKinney-Vento liaison waiver (immediate enrollment)"],
         "McKinney-Vento liaisons at each school district must facilitate immediate enrollment")],
    "childcare": [
        ("Child's birth certificate", True, ["passport", "baptismal record", "hospital birth record"], ""),
        ("Parent/guardian photo ID", True, ["consular ID", "passport", "IDNYC"], ""),
        ("Income documentation for subsidy", True, ["zero-income declaration", "shelter confirmation letter",
                                                    "TANF/HRA letter as income proxy"],
         "ACS child care subsidies available; processing takes 2–4 weeks")],
    "legal_aid": [
        ("Case/court documents (if applicable)", False, ["verbal summary accepted", "caseworker notes",
                                                         "no documents required for intake"],
         "Most legal aid orgs do intake with no documents — they help gather records"),
        ("ID (preferred but not required)", False, ["verbal ID", "any form of ID"], "")],
    "domestic_violence": [
        ("No documentation required", False, [],
         "Safety planning takes priority — no documents needed to access DV services or shelter")],
    "mental_health": [
        ("ID", False, ["verbal ID", "most NYC mental health clinics have no-ID policy for crisis"],
         "988 crisis line requires no ID; ER mental health services covered under EMTALA"),
        ("Insurance", False, ["Medicaid", "NYC mental health sliding scale", "uninsured accepted at NYC clinics"], "")],
    "community_center": [
        ("Proof of borough/neighborhood (sometimes)", False, ["verbal address", "any mail piece"],
         "Most community centers are open to all NYC residents")],
    "senior_services": [
        ("Proof of age (60+)", True, ["any ID showing birthdate", "Medicare card", "Social Security statement"], ""),
        ("Proof of income (for some programs)", False, ["zero-income declaration", "SSI/SSDI letter"], "")],
    "default": [
        ("ID (preferred)", False, ["any government-issued ID", "verbal identification"],
         "Contact intake staff if no ID available")],
}
NO_SUBSTITUTE = "Contact intake supervisor"
FALLBACK = "Request supervisor override or document waiver. "


def document_rows() -> dict:
    """type -> (document, required, best substitute, all substitutes, fallback)."""
    return {t: [(doc, need, subs[0] if subs else NO_SUBSTITUTE, "; ".join(subs), FALLBACK + note)
                for doc, need, subs, note in rows] for t, rows in DOCUMENTS.items()}


PROTOCOLS = {
    "housing": "Intake: assess shelter type needed (single adult vs. family with children). "
               "Families: HRA PATH intake center (151 E. 151st St, Bronx). "
               "Single adults: DHS drop-in centers or call 311. "
               "McKinney-Vento protections for families with school-age children. "
               "If fleeing DV, specialized shelter available — do not list previous address.",
    "shelter": "Emergency shelter is a legal right in NYC under the Callahan Consent Decree. "
               "No one can be turned away in cold weather (below 32°F). "
               "DHS hotline: 311 or 1-800-994-6494. "
               "Safe Haven and drop-in centers for those not ready for shelter system.",
    "food": "No eligibility check required at most NYC food pantries and soup kitchens. "
            "SNAP application assistance often available on-site. "
            "Food Bank for NYC: 1-866-888-8777 for nearest pantry. "
            "WIC available for pregnant women, new mothers, and children under 5.",
    "medical": "EMTALA: hospitals must provide emergency treatment regardless of ability to pay or documentation. "
               "NYC Health + Hospitals financial counselors available same-day. "
               "Ask about NYC Care program (low-cost care for uninsured NYC residents). "
               "Insurance application can be submitted while receiving care.",
    "mental_health": "Mental health crisis: call 988 (Suicide & Crisis Lifeline) or go to any ER. "
                     "Mobile Crisis Teams: 1-800-LIFENET for same-day outreach. "
                     "Outpatient: most clinics accept Medicaid or offer sliding scale. "
                     "No ID required for crisis services. Language access required by law.",
    "benefits": "SNAP, Medicaid, Cash Assistance applications take 30–45 min at HRA. "
                "Apply online at ACCESS HRA app or nyc.gov/hra. "
                "Emergency SNAP available same-day for eligible households. "
                "Fair Fares (50% MetroCard) available for income-eligible New Yorkers.",
    "legal": "Most legal aid is first-come first-served or by appointment. "
             "Emergency legal issues (eviction, custody): call 311 for referral. "
             "Immigration: note DACA/asylum/TPS timelines if relevant. "
             "Language access required — request interpreter if needed.",
    "safety": "Domestic violence: NYC DV Hotline 1-800-621-HOPE (4673), 24/7. "
              "If in immediate danger: call 911. "
              "Safety planning is the first priority before any intake paperwork. "
              "Mandatory reporter obligations may apply for staff members. "
              "Address confidentiality program available for DV survivors.",
    "school": "McKinney-Vento Act: homeless children must be enrolled immediately, even without documents. "
              "Each school district has a McKinney-Vento liaison — contact them directly. "
              "Children in shelter have right to attend school of origin (previous school) if feasible. "
              "Bus transportation available for children in temporary housing.",
    "childcare": "ACS child care subsidies available for income-eligible families. "
                 "Processing takes 2–4 weeks; emergency placements sometimes available. "
                 "Head Start: free early education for income-eligible children 0–5. "
                 "Apply at childcareny.org or through ACS.",
    "employment": "NYC Workforce1 Career Centers: free job placement, resume help, training. "
                  "HireNYC: prioritizes NYC residents for city-contracted jobs. "
                  "SNAP recipients may qualify for employment and training programs.",
    "senior": "NYC Department for the Aging: 311 or nyc.gov/aging. "
              "SNAP eligibility for seniors often higher than general public. "
              "NORC programs provide services in buildings with many seniors.",
}
DEFAULT_PROTOCOL = "Standard intake process applies."

# ---- Eligibility --------------------------------------------------------


def poverty_level(size="household_size") -> Column:
    """Annual poverty level: a table to eight people, linear beyond."""
    table = lookup(f"CAST({size} AS INT)", POVERTY, str(POVERTY[1]))
    return F.expr(f"CASE WHEN {size} > 8 THEN {POVERTY[8]} + ({size} - 8) * {POVERTY_EXTRA} ELSE {table} END")


def with_programs(df: DataFrame) -> DataFrame:
    """Add fpl and ``programs``: array<struct<program, qualifies, amount, estimate>>.

    Needs household_size, annual_income, has_children, has_pregnant,
    housing_status and has_id. All rules are one expression per row.
    """
    snap_max = lookup("least(CAST(household_size AS INT), 8)", SNAP_MAX, str(SNAP_MAX[8]))
    cash = lookup("least(CAST(household_size AS INT), 6)", CASH, str(CASH_DEFAULT))
    df = df.withColumn("fpl", poverty_level().cast("int"))
    df = df.withColumn("_snap", F.expr(
        f"{snap_max} + CASE WHEN household_size > 8 THEN (household_size - 8) * {SNAP_EXTRA} ELSE 0 END"))
    under = lambda share: f"annual_income <= fpl * {share}D"
    medicaid = f"CASE WHEN has_pregnant OR has_children THEN {under(2.23)} ELSE {under(1.38)} END"
    snap = f"CASE WHEN {under(1.3)} THEN greatest(0D, rint(_snap - 0.3D * (annual_income / 12D * 0.8D))) ELSE 0D END"

    def row(key, qualifies, amount="CAST(NULL AS INT)", only=None, text_if=None):
        estimate = quote(ESTIMATE_TEXT[key]) if key in ESTIMATE_TEXT else "CAST(NULL AS STRING)"
        if text_if:
            estimate = f"CASE WHEN {text_if} THEN {estimate} END"
        s = (f"named_struct('key', {quote(key)}, 'program', {quote(PROGRAMS[key][0])}, 'qualifies', {qualifies}, "
             f"'amount', CAST({amount} AS INT), 'estimate', {estimate})")
        return f"CASE WHEN {only} THEN {s} END" if only else s
    wic = f"(has_pregnant OR has_children) AND {under(1.85)}"
    rows = ", ".join([
        row("snap", under(1.3), snap), row("medicaid", medicaid, text_if=medicaid), row("wic", wic, text_if=wic),
        row("cash_assistance", under(1.0), f"CASE WHEN {under(1.0)} THEN {cash} ELSE 0 END"),
        row("school_meals", "has_children", text_if="has_children"),
        row("emergency_shelter", "true", only="housing_status IN ('homeless', 'at_risk')"),
        row("fair_fares", under(1.2)), row("document_assistance", "true", only="NOT has_id")])
    return df.withColumn("programs", F.expr(f"filter(array({rows}), p -> p IS NOT NULL)")).drop("_snap")


def eligibility(df: DataFrame, key="household_id") -> DataFrame:
    """One row per household and program, with where and how to apply."""
    out = with_programs(df).select(key, F.explode("programs").alias("p")).select(key, "p.*")
    at = lambda i, sep=None: {k: (sep.join(v[i]) if sep else v[i]) for k, v in PROGRAMS.items()}
    return out.withColumns({"documents": F.expr(lookup("key", at(1, "; "))), "where_to_apply": F.expr(lookup("key", at(2))),
                            "how_long": F.expr(lookup("key", at(3)))})


def benefit_totals(df: DataFrame, key="household_id") -> DataFrame:
    """Qualifying programs, monthly total and share of the poverty level."""
    return with_programs(df).select(
        key, F.col("fpl").alias("fpl_for_household"), round_even(F.col("annual_income") / F.col("fpl") * F.lit(100.0)).alias("pct_fpl"),
        F.expr("transform(filter(programs, p -> p.qualifies), p -> p.program)").alias("qualifying_programs"),
        F.expr("aggregate(programs, 0L, (s, p) -> s + coalesce(p.amount, 0))").alias("estimated_monthly_benefits"))


# ---- Lookups ------------------------------------------------------------


def _listing(table: dict, names, key: str) -> str:
    """array<struct> of a key's rows, else those of 'default'."""
    rows = lambda rs: "array(" + ", ".join("named_struct(" + ", ".join(
        f"{quote(n)}, {literal(v)}" for n, v in zip(names, r)) + ")" for r in rs) + ")"
    pairs = ", ".join(f"{quote(k)}, {rows(v)}" for k, v in table.items() if k != "default")
    return f"coalesce(element_at(map({pairs}), {key}), {rows(table['default'])})"


def rights_for_type(c: str, n=None) -> Column:
    """Rights of a resource type in order, the default ones for other types."""
    rights = _listing(RIGHTS, ["right", "detail"], c)
    return F.expr(f"slice({rights}, 1, {n})" if n else rights)


def required_documents(c: str) -> Column:
    """Documents asked for at a resource type, with the risk of a gap."""
    docs = _listing(document_rows(), ["doc", "required", "substitute", "substitutes", "fallback_process"], c)
    return F.expr(f"transform({docs}, d -> named_struct('doc', d.doc, 'required', d.required, 'gap_risk', "
                  "CASE WHEN d.required THEN 'high' ELSE 'low' END, 'substitute', d.substitute, "
                  "'substitutes', d.substitutes, 'fallback_process', d.fallback_process))")


def stories_for_need(c: str, k=3) -> Column:
    """Ids of the first k stories about a need, or the first k of all."""
    rows = "array(" + ", ".join(
        f"named_struct('id', {quote(i)}, 'needs', array({', '.join(map(quote, ns))}))" for i, ns, *_ in STORIES) + ")"
    hits = f"filter({rows}, s -> array_contains(s.needs, {c}))"
    pick = f"CASE WHEN {c} IS NULL OR size({hits}) = 0 THEN {rows} ELSE {hits} END"
    return F.expr(f"transform(slice({pick}, 1, {k}), s -> s.id)")


def story_details(ids: str) -> Column:
    """The stories behind an array of ids: array<struct>, in the same order."""
    names = ["id", "timeframe", "name", "age_range", "situation", "outcome", "quote"]
    pairs = ", ".join(f"{quote(i)}, named_struct(" + ", ".join(
        f"{quote(n)}, {quote(v)}" for n, v in zip(names, (i, *rest))) + ")" for i, _, *rest in STORIES)
    return F.expr(f"transform({ids}, i -> element_at(map({pairs}), i))")


def profile_rights() -> Column:
    """Rights that follow from the household's own flags."""
    rows = ", ".join(f"CASE WHEN {c} THEN named_struct('right', {quote(r)}, 'detail', {quote(d)}) END"
                     for c, r, d in PROFILE_RIGHTS)
    return F.expr(f"filter(array({rows}), r -> r IS NOT NULL)")


def service_protocol(needs: str, kind: str) -> Column:
    """Protocol of the first open need that has one, else of the type, else standard.

    ``needs``: array of open need categories in order.
    """
    have = "array(" + ", ".join(map(quote, PROTOCOLS)) + ")"
    first = f"get(filter({needs}, n -> array_contains({have}, n)), 0)"
    return F.expr(lookup(f"coalesce({first}, {kind})", PROTOCOLS, quote(DEFAULT_PROTOCOL)))


# ---- Action plan --------------------------------------------------------


def action_plan(needs: DataFrame, results: DataFrame, programs: DataFrame, key="request_id") -> DataFrame:
    """One step per need: when, where, alternatives, rights, programs.

    ``needs``: key, category, priority. ``results``: key, result_key (the
    searched types joined by +), key_order, rank, name, resource_type.
    ``programs``: key, qualifying_programs. A need takes the result set with
    its own name, else the first that covers one of its mapped types, else the
    first whose name contains it or is contained in it.
    """
    mapped = ", ".join(f"{quote(k)}, array({', '.join(map(quote, v))})" for k, v in TYPE_EXPANSION.items())
    sets = results.groupBy(key, "result_key", "key_order").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("name", "resource_type"))).alias("_top"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank").between(2, 4), F.struct("rank", "name")))),
                                 lambda s: s["name"]), "; ").alias("alternatives"))
    pairs = needs.withColumn("_types", F.expr(f"coalesce(element_at(map({mapped}), lower(category)), array(category))"))
    pairs = pairs.join(sets, key, "left")
    level = (F.when(F.col("result_key") == F.col("category"), 0)
             .when(F.expr("exists(_types, t -> contains(result_key, t))"), 1)
             .when(F.expr("contains(result_key, category) OR contains(category, result_key)"), 2))
    best = F.min(F.when(level.isNotNull(), F.struct(level.alias("level"), "key_order", "result_key",
                                                    "_top", "alternatives"))).alias("b")
    step = pairs.groupBy(key, "category", "priority").agg(best)
    step = step.select(key, "category", F.expr(lookup("category", PRIORITY_ORDER, "priority")).cast("int").alias("priority"),
                       F.col("b._top.name").alias("top_resource"), F.col("b._top.resource_type").alias("_kind"),
                       F.coalesce("b.alternatives", F.lit("")).alias("alternatives"))
    step = step.withColumns({
        "timeframe": F.expr(lookup("priority", TIME_FRAMES, "'SOON'")),
        "action": F.expr("concat('Address ', replace(category, '_', ' '), ' need')"),
        "_right_of": F.coalesce("_kind", "category")})
    step = step.withColumn(
        "rights", F.array_join(F.transform(rights_for_type("_right_of", 3), lambda r: r["right"]), "; "))
    wanted = """CASE WHEN category IN ('benefits', 'documents', 'id') THEN qualifying_programs
        WHEN category = 'food' THEN filter(qualifying_programs, p -> contains(p, 'SNAP') OR contains(p, 'WIC') OR contains(lower(p), 'meal'))
        WHEN category = 'medical' THEN filter(qualifying_programs, p -> contains(p, 'Medicaid'))
        WHEN category = 'school' THEN filter(qualifying_programs, p -> contains(p, 'School')) END"""
    step = step.join(programs.select(key, "qualifying_programs"), key, "left")
    return step.withColumn("eligibility", F.array_join(F.expr(wanted), "; ")).drop("qualifying_programs", "_kind", "_right_of")
