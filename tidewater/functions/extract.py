"""Fields of award pages: degree levels, modes, funding, eligibility and requirements, as Column functions.

Absent is not false: a flag is null where a text says nothing, and false only where it denies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import dates, money
from tidewater.functions.patterns import ascii_edges, let, settled, whole_words
from tidewater.functions.places import countries_in, regions_in
from tidewater.functions.text import sentences

_p = whole_words

#: Degree levels in order, and the wording of each.
DEGREES = {
    "PHD": _p(r"doctor\s+of\s+philosophy|ph\.?\s?d\.?s?|d\.?phil\.?|doctoral|doctorate|postgraduate\s+research|research\s+degree|edd|dba"),
    "MASTERS": _p(
        r"postgraduate\s+taught|master'?s?\s+degree|masters?|m\.?sc\.?|m\.?a\.?|m\.?eng\.?|m\.?b\.?a\.?|m\.?p\.?h\.?|m\.?phil\.?|m\.?res\.?|l\.?l\.?m\.?|m\.?arch\.?|m\.?fa\.?"
        r"|postgraduate|graduate\s+(?:study|studies|programme|program)|pgt"
    ),
    "BACHELORS": _p(r"bachelor'?s?\s+degree|bachelors?|undergraduate|b\.?sc\.?|b\.?a\.?|b\.?eng\.?|l\.?l\.?b\.?|b\.?com\.?|b\.?ed\.?|first\s+degree"),
    "POSTDOC": _p(r"post-?doctoral|post-?doc"),
    "RESEARCH_FELLOWSHIP": _p(r"research\s+fellowship"),
    "DIPLOMA": _p(r"diploma|hnd"),
    "CERTIFICATE": _p(r"certificate|pgce"),
}
#: Wording of what applicants must hold already, and of what an award is for.
HELD = _p(
    r"must\s+(?:hold|have|possess|already\s+have)|hold(?:ing)?\s+an?\b|have\s+(?:completed|obtained|been\s+awarded)|completed\s+an?\b|awarded\s+an?\b|in\s+possession\s+of"
    r"|entry\s+requirements?|minimum\s+(?:degree|qualification)|equivalent\s+(?:to|of)\s+an?\b|applicants?\s+(?:must|should|require|need)|require[sd]?\s+an?\b|graduated\s+with"
    r"|obtained\s+an?\b|prior\s+(?:degree|qualification)|first\s+degree\s+in"
)
OFFERED = _p(
    r"scholarships?|studentships?|bursar(?:y|ies)|fellowships?|award|funding|open\s+to|available\s+to|supports?|for\s+students?|programmes?\s+covered|eligible\s+(?:programmes?|courses?)"
    r"|study\s+towards?|to\s+study|enrol(?:ling|led)?\s+(?:on|in)"
)


def degree(text: Column) -> Column:
    """The first level, in the order of DEGREES, that a phrase names; null if none."""
    known = F.coalesce(text, F.lit(""))
    return reduce(lambda chain, item: chain.when(known.rlike(item[1]), item[0]), list(DEGREES.items())[1:], F.when(known.rlike(DEGREES["PHD"]), "PHD"))


def with_degree_levels(df: DataFrame, text: str, name: str = "degree") -> DataFrame:
    """Adds a struct(levels, prerequisite_levels, confidence): what an award is for, and what it only asks for.

    A sentence of both kinds counts for the nearer wording. Levels that are offered
    anywhere are no prerequisites.
    """
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?;:])\s+|\n+|\s[•·▪‣–—]\s"), lambda s: F.length(F.trim(s)) > 2)
    at = lambda s, pattern: F.regexp_instr(s, F.lit(pattern)) - 1

    def judge(s: Column) -> Column:
        held, offered = s.rlike(HELD), s.rlike(OFFERED)
        cases = []
        for level, pattern in DEGREES.items():
            nearer = F.abs(at(s, pattern) - at(s, HELD)) < F.abs(at(s, pattern) - at(s, OFFERED))
            cases.append(F.when(s.rlike(pattern), F.struct(F.lit(level).alias("level"), (held & (~offered | nearer)).alias("held"))))
        return F.array_compact(F.array(*cases))

    step = df.withColumn("_found", F.flatten(F.transform(parts, judge)))
    pick = lambda held: F.array_distinct(F.transform(F.filter("_found", lambda x: x["held"] == held), lambda x: x["level"]))
    step = step.withColumn("_levels", pick(False))
    explicit = F.col(text).rlike(ascii_edges(r"(?i)\b(?:bachelor|master|doctoral|doctorate|ph\.?d|undergraduate|postgraduate)\w*\b"))
    confidence = F.when(F.size("_levels") == 0, 0.0).when(explicit, 0.9).otherwise(0.6)
    return step.withColumn(name, F.struct(F.col("_levels").alias("levels"), F.array_except(pick(True), "_levels").alias("prerequisite_levels"), confidence.alias("confidence"))).drop("_found", "_levels")


#: Study modes, attendance and delivery.
STUDY = {
    "HYBRID": _p(r"hybrid|blended\s+(?:learning|delivery|mode)|mixed\s+mode"),
    "DISTANCE": _p(r"distance\s+learning|distance\s+education|by\s+distance|correspondence"),
    "ONLINE": _p(r"online|fully\s+online|e-?learning|virtual\s+(?:study|delivery|classroom)|remote\s+(?:study|learning)"),
    "ON_CAMPUS": _p(r"on[-\s]?campus|in[-\s]?person\s+(?:study|attendance)|campus[-\s]based|face[-\s]to[-\s]face|attend\s+in\s+person"),
}
DELIVERY = {"MIXED": _p(r"hybrid|blended|mixed\s+mode"), "REMOTE": _p(r"remote(?:ly)?|online|virtual|distance"), "IN_PERSON": _p(r"in[-\s]?person|on[-\s]?campus|face[-\s]to[-\s]face")}
_FULL, _PART = _p(r"full[-\s]?time"), _p(r"part[-\s]?time")
_BOTH_TIMES = _p(r"full[-\s]?time\s*(?:/|,|\bor\b|\band\b)\s*part[-\s]?time|part[-\s]?time\s*(?:/|,|\bor\b|\band\b)\s*full[-\s]?time|full\s+and\s+part[-\s]?time")


def _listed(text: Column, rules: dict[str, str]) -> Column:
    found = F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(p), v) for v, p in rules.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit("UNKNOWN"))).otherwise(found)


def study_mode(text: Column) -> Column:
    return _listed(text, STUDY)


def delivery_mode(text: Column) -> Column:
    return _listed(text, DELIVERY)


def attendance(text: Column) -> Column:
    """[BOTH] if a text names both, together or apart; [UNKNOWN] if it names none."""
    known = F.coalesce(text, F.lit(""))
    full, part = known.rlike(_FULL), known.rlike(_PART)
    return F.array(F.when(known.rlike(_BOTH_TIMES) | (full & part), "BOTH").when(full, "FULL_TIME").when(part, "PART_TIME").otherwise("UNKNOWN"))


#: Words that deny.
_NOT = r"(?:not?\b|does\s+not|doesn'?t|will\s+not|won'?t|no\b|excluded|excludes|without|are\s+not|is\s+not)"
#: What a text may say to be covered.
COVERAGE = {
    "tuitionCovered": _p(r"tuition|tuition\s+fees?|course\s+fees?|full\s+fees?|fee[s]?\s+(?:are\s+)?(?:covered|paid|waived)|fee\s+waiver"),
    "livingStipend": _p(r"stipend|living\s+(?:allowance|costs?|expenses?|stipend)|maintenance\s+(?:grant|allowance|loan)|monthly\s+allowance|subsistence"),
    "travelCovered": _p(r"travel\s+(?:costs?|allowance|grant|expenses?|award)|transport\s+allowance"),
    "airfareCovered": _p(r"airfare|air\s+ticket|flight[s]?\s+(?:costs?|are\s+covered|covered)|return\s+(?:flight|airfare)"),
    "accommodationCovered": _p(r"accommodation|housing\s+(?:allowance|costs?)|hall[s]?\s+of\s+residence|lodging|hostel\s+fees?"),
    "healthInsurance": _p(r"health\s+insurance|medical\s+(?:insurance|cover(?:age)?)|health\s+cover(?:age)?"),
    "researchAllowance": _p(r"research\s+(?:allowance|costs?|grant|training\s+support|expenses?)|bench\s+fees?|RTSG"),
    "booksAllowance": _p(r"book\s+allowance|books?\s+and\s+(?:materials|supplies)|study\s+materials"),
    "equipmentAllowance": _p(r"equipment\s+(?:allowance|grant)|laptop\s+(?:allowance|provided)|computer\s+allowance"),
    "applicationFeeWaiver": _p(r"application\s+fee\s+(?:waiver|waived|is\s+waived)|no\s+application\s+fee|fee\s+waiver\s+for\s+application"),
    "visaSupport": _p(r"visa\s+(?:costs?|fees?|support|application\s+fee)|immigration\s+health\s+surcharge|IHS"),
}
KINDS = {
    "MERIT_BASED": _p(r"merit[-\s]based|academic\s+merit|based\s+on\s+(?:academic\s+)?(?:merit|excellence|achievement)"),
    "NEED_BASED": _p(r"need[-\s]based|financial\s+need|means[-\s]tested|demonstrated\s+need"),
    "SPORTS": _p(r"sport(?:s|ing)?\s+scholarship|athletic\s+scholarship"),
    "GOVERNMENT": _p(r"government\s+(?:scholarship|funded|scheme)|ministry\s+of\s+(?:education|higher)|state[-\s]funded|national\s+scholarship"),
    "FELLOWSHIP": _p(r"fellowship|fellow\b"),
}
FULLY = _p(r"fully[-\s]funded|full\s+scholarship|covers\s+all\s+costs|100%\s+(?:of\s+)?(?:the\s+)?(?:tuition|fees|costs)")
PARTLY = _p(r"partial(?:ly)?[-\s]funded|partial\s+(?:scholarship|award|funding)|contribution\s+towards")
_HEDGE = _p(r"may|might|could|possibly|potentially|in\s+some\s+cases|where\s+applicable|subject\s+to")


def first_said(parts: Column, pattern: str) -> Column:
    """struct(said, at, size): the first sentence that matches, where the match begins (from 1) and how long it is; null if none does."""
    at = F.transform(F.slice(F.filter(parts, lambda s: s.rlike(pattern)), 1, 1), lambda s: F.struct(s.alias("said"), F.regexp_instr(s, F.lit(pattern)).alias("at"), F.length(F.regexp_extract(s, pattern, 0)).alias("size")))
    return F.try_element_at(at, F.lit(1))


_DENIED_BEFORE, _DENIED_AFTER = ascii_edges(rf"(?i){_NOT}\s+(?:\w+\s+){{0,3}}$"), ascii_edges(rf"(?i)^\s*(?:\w+\s+){{0,3}}(?:is|are|will\s+be)?\s*{_NOT}")


def flag(first: Column) -> Column:
    """struct(value, certainty, confidence, source_text) from first_said(): denied within three words is false, hedged is only probable."""
    said = first["said"]
    before, after = F.substring(said, F.lit(1), (first["at"] - 1).cast("int")), F.substring(said, (first["at"] + first["size"]).cast("int"), F.length(said))
    kind = F.when(said.isNull(), "UNKNOWN").when(before.rlike(_DENIED_BEFORE) | after.rlike(_DENIED_AFTER), "NEGATIVE").when(said.rlike(_HEDGE), "PROBABLE").otherwise("CONFIRMED")
    at = F.transform(F.array(kind), lambda k: F.struct(
        F.when(k != "UNKNOWN", k != "NEGATIVE").alias("value"), k.alias("certainty"),
        F.when(k == "UNKNOWN", 0.0).when(k == "NEGATIVE", 0.8).when(k == "PROBABLE", 0.55).otherwise(0.9).alias("confidence"), said.alias("source_text"),
    ))
    return at[0]


def with_funding(df: DataFrame, text: str, name: str = "funding") -> DataFrame:
    """Adds a struct of the coverage flags, types, primaryType, primaryTypeCertainty, stipendAmount, tuitionPercentage, awardCount and rawFundingText."""
    whole = F.coalesce(F.col(text), F.lit(""))
    step = settled(df, _s=sentences(whole))
    step = settled(step, **{f"_said_{k}": first_said(F.col("_s"), p) for k, p in COVERAGE.items()})
    step = settled(step, **{f"_{k}": flag(F.col(f"_said_{k}")) for k in COVERAGE})
    yes = lambda k: F.coalesce(F.col(f"_{k}.value"), F.lit(False))
    tuition, living, full, part = yes("tuitionCovered"), yes("livingStipend"), whole.rlike(FULLY), whole.rlike(PARTLY)
    primary = F.when(full | (tuition & living), "FULLY_FUNDED").when(part, "PARTIALLY_FUNDED").when(tuition, "TUITION_ONLY").when(living, "LIVING_STIPEND").otherwise("UNKNOWN")
    sure = F.when(full, "CONFIRMED").when(tuition & living, "PROBABLE").when(part, "CONFIRMED").when(tuition, F.col("_tuitionCovered.certainty")).when(living, F.col("_livingStipend.certainty")).otherwise("UNKNOWN")
    both = tuition & living
    types = [
        F.when(full | both, "FULLY_FUNDED"), F.when(~full & ~both & part, "PARTIALLY_FUNDED"), F.when(~full & ~both & ~part & tuition, "TUITION_ONLY"), F.when(both, "TUITION_PLUS_STIPEND"), F.when(living, "LIVING_STIPEND"),
        F.when(yes("travelCovered") | yes("airfareCovered"), "TRAVEL_GRANT"), F.when(yes("accommodationCovered"), "ACCOMMODATION"),
        F.when(yes("applicationFeeWaiver"), "APPLICATION_FEE_WAIVER"), F.when(yes("researchAllowance"), "RESEARCH_FUNDING"), *[F.when(whole.rlike(p), k) for k, p in KINDS.items()],
    ]
    raw = F.slice(F.filter("_s", lambda s: s.rlike(COVERAGE["tuitionCovered"]) | s.rlike(COVERAGE["livingStipend"]) | s.rlike(FULLY) | s.rlike(PARTLY)), 1, 12)
    found = F.struct(
        *[F.col(f"_{k}").alias(k) for k in COVERAGE], F.array_compact(F.array(*types)).alias("types"), primary.alias("primaryType"), sure.alias("primaryTypeCertainty"),
        money.money_near(F.col("_s"), COVERAGE["livingStipend"]).alias("stipendAmount"), money.tuition_percentage(F.col("_s"), COVERAGE["tuitionCovered"]).alias("tuitionPercentage"),
        money.award_count(F.col("_s")).alias("awardCount"), raw.alias("rawFundingText"),
    )
    return step.withColumn(name, found).drop("_s", *[f"_{k}" for k in COVERAGE], *[f"_said_{k}" for k in COVERAGE])


#: Wording of scopes, lists of countries, exclusions and groups.
INTERNATIONAL = _p(
    r"international\s+(?:students?|applicants?|candidates?)|overseas\s+(?:students?|applicants?)|non[-\s]?(?:UK|EU|US|domestic|home)\s+(?:students?|applicants?|nationals?)"
    r"|students?\s+from\s+(?:outside|any\s+country)|foreign\s+(?:students?|nationals?)"
)
DOMESTIC = _p(
    r"home\s+(?:students?|fee\s+status|applicants?)|domestic\s+(?:students?|applicants?)|(?:UK|US|Irish|Australian|Canadian)\s+(?:students?|nationals?|citizens?|residents?)\s+only"
    r"|resident\s+students?\s+only|in[-\s]state"
)
EVERYONE = _p(
    r"home\s+and\s+(?:international|overseas)|(?:international|overseas)\s+and\s+home|(?:UK|EU)\s+and\s+international|all\s+(?:students?|applicants?|nationalities)"
    r"|regardless\s+of\s+nationality|any\s+nationality|open\s+to\s+all"
)
LISTING = _p(r"open\s+to|available\s+to|restricted\s+to|eligible\s+(?:applicants?\s+)?(?:are|must\s+be)|applicants?\s+must\s+be|citizens?\s+of|nationals?\s+of|residents?\s+of|from")
EXCLUDING = _p(r"not\s+(?:open|available|eligible)\s+(?:to|for)|excluding|except\s+(?:for)?|are\s+not\s+eligible|ineligible")
GROUPS = {
    "women": ascii_edges(r"(?i)\b(?:women\s+only|female\s+(?:applicants?|students?|candidates?)\s+only|open\s+(?:only\s+)?to\s+women|for\s+women\s+in\b)"),
    "women_in_stem": _p(r"women\s+in\s+(?:STEM|science|engineering|technology|computing)"),
    "refugees": _p(r"refugees?|asylum\s+seekers?|displaced\s+(?:persons?|students?)|sanctuary\s+scholarship"),
    "disability": _p(r"(?:students?|applicants?|candidates?)\s+with\s+(?:a\s+)?disabilit(?:y|ies)|disabled\s+(?:students?|applicants?|candidates?)"),
    "first_generation": _p(r"first[-\s]generation\s+(?:students?|university|college)"),
    "care_leavers": _p(r"care\s+leavers?"),
    "indigenous": _p(r"(?:indigenous|first\s+nations|aboriginal)\s+(?:students?|applicants?|peoples?)"),
    "low_income": _p(r"low[-\s]income\s+(?:background|famil|household)|financially\s+disadvantaged|underprivileged"),
    "commonwealth": _p(r"commonwealth\s+(?:citizens?|countr(?:y|ies)|scholar)"),
}
#: How ages are written.
AGED = ascii_edges(r"(?i)\bage[ds]?\b|\byears?\s+old\b")
AGE_RANGE = ascii_edges(r"(?i)\b(?:aged?\s+)?(\d{2})\s*(?:-|to|and)\s*(\d{2})\s*(?:years)?\b")
AGE_BELOW = ascii_edges(r"(?i)\b(?:under|below|younger\s+than|no\s+older\s+than|maximum\s+age\s+(?:of\s+)?)\s*(\d{2})\b")
AGE_ABOVE = ascii_edges(r"(?i)\b(?:over|above|at\s+least|minimum\s+age\s+(?:of\s+)?|older\s+than)\s*(\d{2})\b")
NEAR_LISTING = ascii_edges(r"(?i)\beligib|\bopen\s+to\b")
DEVELOPING = _p(r"developing\s+countr(?:y|ies)|low[-\s]income\s+countr(?:y|ies)|least\s+developed\s+countr(?:y|ies)|ODA[-\s]?eligible|DAC\s+list")


def with_eligibility(df: DataFrame, text: str, name: str = "eligibility") -> DataFrame:
    """Adds a struct: scope, scopeCertainty, countries, excludedCountries, regions, categories, womenOnly, refugeesEligible, developingCountriesOnly, ageMin, ageMax.

    Only sentences that list who may apply give countries; a country that is also excluded is not listed.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    step = df.withColumn("_s", sentences(whole, 4, 699))
    step = step.withColumns({"_list": F.filter("_s", lambda s: s.rlike(LISTING) & ~s.rlike(EXCLUDING)), "_out": F.filter("_s", lambda s: s.rlike(EXCLUDING))})
    step = step.withColumns({"_excluded": F.array_distinct(F.flatten(F.transform("_out", countries_in))), "_named": F.array_distinct(F.flatten(F.transform("_list", countries_in)))})
    near = F.concat("_list", F.filter("_s", lambda s: s.rlike(NEAR_LISTING)))
    step = step.withColumns({"_countries": F.array_except("_named", "_excluded"), "_regions": F.array_distinct(F.flatten(F.transform(near, regions_in)))})
    says = lambda p: F.exists("_s", lambda s: s.rlike(p))
    true = lambda p: F.when(says(p), F.lit(True))
    listed, region = F.size("_countries") > 0, (F.size("_regions") > 0) & (F.size("_list") > 0)
    both, abroad, home = says(EVERYONE), says(INTERNATIONAL), says(DOMESTIC)
    scope = F.when(listed, "SPECIFIC_COUNTRIES").when(region, "SPECIFIC_REGIONS").when(both | (abroad & home), "BOTH").when(abroad, "INTERNATIONAL").when(home, "DOMESTIC").otherwise("UNKNOWN")
    sure = F.when(listed | region | both, "CONFIRMED").when(abroad & home, "PROBABLE").when(abroad | home, "CONFIRMED").otherwise("UNKNOWN")
    aged = F.filter("_s", lambda s: s.rlike(AGED))
    number = lambda p, g=1: F.try_element_at(F.filter(F.transform(aged, lambda s: F.regexp_extract(s, p, g).try_cast("int")), lambda n: n.isNotNull()), F.lit(1))
    below, above = number(AGE_BELOW), number(AGE_ABOVE)
    neither = below.isNull() & above.isNull()
    found = F.struct(
        scope.alias("scope"), sure.alias("scopeCertainty"), F.col("_countries").alias("countries"), F.col("_excluded").alias("excludedCountries"), F.col("_regions").alias("regions"),
        F.array_compact(F.array(*[F.when(whole.rlike(p), k) for k, p in GROUPS.items()])).alias("categories"), true(GROUPS["women"]).alias("womenOnly"),
        true(GROUPS["refugees"]).alias("refugeesEligible"), true(DEVELOPING).alias("developingCountriesOnly"),
        F.when(neither, number(AGE_RANGE, 1)).otherwise(above).alias("ageMin"), F.when(neither, number(AGE_RANGE, 2)).otherwise(below).alias("ageMax"),
    )
    return step.withColumn(name, found).drop("_s", "_list", "_out", "_excluded", "_named", "_countries", "_regions")


#: English tests with the range of their scores.
ENGLISH = {
    "ielts": (r"IELTS", r"\b(\d(?:\.\d)?)\b", 0, 9), "toefl": (r"TOEFL", r"\b(\d{2,3})\b", 0, 120), "pte": (r"PTE", r"\b(\d{2,3})\b", 10, 90),
    "cambridge": (r"Cambridge\s+(?:English|Advanced|Proficiency)|CAE|CPE|C1\s+Advanced|C2\s+Proficiency", r"\b(\d{2,3})\b", 80, 230), "duolingo": (r"Duolingo", r"\b(\d{2,3})\b", 10, 160),
}
_WAIVED = _p(r"waive[dr]?|exempt(?:ion|ed)?|not\s+required|no\s+(?:English\s+)?(?:language\s+)?test|may\s+be\s+waived")
_UNNEEDED = _p(r"not?\s+required|no\s+(?:IELTS|TOEFL|English\s+test)|without\s+(?:an?\s+)?(?:IELTS|TOEFL|English\s+test)")


def english_test(parts: Column, test: str) -> Column:
    """struct(required, minScore, waiverAvailable): the sentence with a score in range wins, else the first that names the test. The score is sought 4 characters after the name's start."""
    name, score, low, high = ENGLISH[test]
    value = lambda s: F.regexp_extract(F.substring(s, (F.regexp_instr(s, F.lit(_p(name))) + 4).cast("int"), F.length(s)), ascii_edges(score), 1).try_cast("double")

    def told(found: Column) -> Column:
        free = found["chosen"].rlike(_UNNEEDED)
        return F.struct((~free).alias("required"), F.when(~free, value(found["rated"])).alias("minScore"), F.when(free | found["chosen"].rlike(_WAIVED), F.lit(True)).alias("waiverAvailable"))

    def chosen(named: Column) -> Column:
        rated = F.try_element_at(F.filter(named, lambda s: value(s).between(low, high)), F.lit(1))
        return let(rated, lambda r: F.struct(r.alias("rated"), F.coalesce(r, F.try_element_at(named, F.lit(1))).alias("chosen")))

    return let(let(F.filter(parts, lambda s: s.rlike(_p(name))), chosen), told)


#: Wording of work experience and of a grade point average.
EXPERIENCE = _p(r"work\s+experience|professional\s+experience|years?\s+of\s+experience|employment\s+history")
YEARS = ascii_edges(r"(?i)\b(?:at\s+least\s+|minimum\s+(?:of\s+)?)?(\d{1,2})\s*(?:\+)?\s*years?\b")
GPA = ascii_edges(r"(?i)\bGPA\s*(?:of\s*)?(?:at\s+least\s*)?(?:>=?\s*)?(\d(?:\.\d{1,2})?)\s*(?:/\s*(\d(?:\.\d)?)|\s+on\s+a\s+(\d(?:\.\d)?)[-\s]point)?")
LEAST_GPA = ascii_edges(r"(?i)\b(?:minimum|min\.?)\s+(?:cumulative\s+)?GPA\s*(?:of\s*)?(\d(?:\.\d{1,2})?)")


def work_years(parts: Column) -> Column:
    """Years of work experience (1 to 30) that the first sentence about it asks for."""

    def asked(said: Column) -> Column:
        years = F.regexp_extract(said, YEARS, 1).try_cast("int")
        return F.when(~said.rlike(_UNNEEDED) & years.between(1, 30), years)

    return let(F.try_element_at(F.filter(parts, lambda s: s.rlike(EXPERIENCE)), F.lit(1)), asked)


def minimum_gpa(parts: Column) -> Column:
    """struct(value, scale): the first GPA of up to 10; without a scale 4 for values up to 4."""
    g = lambda s, i: F.regexp_extract(s, GPA, i).try_cast("double")
    first = lambda s: F.coalesce(g(s, 1), F.regexp_extract(s, LEAST_GPA, 1).try_cast("double"))
    found = F.transform(parts, lambda s: F.struct(first(s).alias("value"), F.coalesce(g(s, 2), g(s, 3), F.when(first(s) <= 4, 4.0)).alias("scale")))
    return F.try_element_at(F.filter(found, lambda x: (x["value"] > 0) & (x["value"] <= 10)), F.lit(1))


#: Grades, fields of study, and the wording around them.
GRADE = ascii_edges(
    r"(?i)\b(?:minimum\s+(?:of\s+)?|at\s+least\s+(?:a\s+)?|equivalent\s+(?:to|of)\s+(?:a\s+)?)?((?:upper|lower)\s+second[-\s]class(?:\s+honours)?|first[-\s]class(?:\s+honours)?"
    r"|2[:.]1|2[:.]2|second\s+class\s+(?:upper|lower)|distinction|merit|credit|[A-C][+-]?\s+average)\b"
)
GRADED = _p(r"minimum|at\s+least|require|equivalent|classification|honours")
FIELD = _p(
    r"engineering|computer\s+science|medicine|law|business|economics|agriculture|education|nursing|public\s+health|environmental\s+science|data\s+science|mathematics|physics|chemistry"
    r"|biology|social\s+sciences?|humanities|architecture|psychology|veterinary|pharmacy|journalism|finance|accounting|statistics|artificial\s+intelligence|renewable\s+energy|climate\s+change"
)
FIELDED = _p(r"field|discipline|subject|programme|program|course|stud(?:y|ies)\s+in|degree\s+in|applicants?\s+in")
DEGREE_HELD = (_p(r"hold|holding|possess|must\s+have|require[sd]?|completed?|awarded"), _p(r"bachelor|master|degree|honours|first\s+degree|undergraduate|postgraduate"))
#: Documents with their labels, where they are asked for, and how their number is written.
DOCUMENTS = {
    "CV": ("CV / Résumé", _p(r"curriculum\s+vitae|CV|r[ée]sum[ée]")),
    "TRANSCRIPT": ("Academic transcripts", _p(r"transcripts?|academic\s+records?|mark\s+sheets?")),
    "STATEMENT_OF_PURPOSE": ("Statement of purpose", _p(r"statement\s+of\s+purpose|SOP|motivation\s+letter|letter\s+of\s+motivation")),
    "PERSONAL_STATEMENT": ("Personal statement", _p(r"personal\s+statement")),
    "RESEARCH_PROPOSAL": ("Research proposal", _p(r"research\s+proposal|project\s+proposal")),
    "REFERENCES": ("Reference letters", _p(r"recommendation\s+letters?|letters?\s+of\s+recommendation|referee\s+reports?|references?")),
    "PORTFOLIO": ("Portfolio", _p(r"portfolio")),
    "PASSPORT": ("Passport copy", _p(r"passport(?:\s+copy)?|copy\s+of\s+(?:your\s+)?passport")),
    "PROOF_OF_NATIONALITY": ("Proof of nationality", _p(r"proof\s+of\s+(?:nationality|citizenship)|national\s+ID|birth\s+certificate")),
    "DEGREE_CERTIFICATE": ("Degree certificate", _p(r"degree\s+certificates?|graduation\s+certificates?|award\s+certificates?")),
    "ENGLISH_CERTIFICATE": ("English test certificate", _p(r"English\s+(?:language\s+)?(?:test\s+)?certificate|proof\s+of\s+English")),
    "FINANCIAL_STATEMENT": ("Proof of funds / financial statement", _p(r"bank\s+statements?|proof\s+of\s+funds?|financial\s+statement")),
    "ADMISSION_LETTER": ("Offer / admission letter", _p(r"offer\s+letter|admission\s+letter|letter\s+of\s+(?:offer|admission)|unconditional\s+offer")),
}
ASKED = _p(r"document|submit|upload|provide|attach|require|include|application\s+(?:pack|form|materials)|checklist|supporting")
MANDATORY = _p(r"must|required|mandatory|essential")
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4}
#: Wording of registration, supervisors and offers of a place.
REGISTERED = _p(r"professional\s+(?:registration|licence|license|body|certification)|registered\s+with\s+the|chartered\s+status")
SUPERVISED = _p(r"supervisor|supervisory\s+team|academic\s+supervisor|identify\s+a\s+supervisor|agreed\s+supervisor")
ADMITTED = _p(r"(?:an\s+)?(?:unconditional\s+)?offer\s+of\s+(?:admission|a\s+place)|must\s+have\s+(?:been\s+)?(?:accepted|admitted)|hold\s+an\s+offer|admission\s+offer")


def _first(parts: Column, *patterns: str) -> Column:
    """The first sentence that matches all patterns; null if none does."""
    return F.try_element_at(F.filter(parts, lambda s: reduce(lambda a, b: a & b, [s.rlike(p) for p in patterns])), F.lit(1))


def minimum_grade(parts: Column) -> Column:
    """The grade that the first sentence about a least grade names."""
    return F.nullif(F.trim(F.regexp_extract(_first(parts, GRADE, GRADED), GRADE, 1)), F.lit(""))


def fields_of_study(parts: Column) -> Column:
    """Fields that sentences about courses name, lower-cased and distinct, in order of mention."""
    named = F.flatten(F.transform(F.filter(parts, lambda s: s.rlike(FIELDED)), lambda s: F.regexp_extract_all(s, F.lit(f"({FIELD})".replace("((?i)", "(?i)(")), F.lit(1))))
    return F.array_distinct(F.transform(named, lambda f: F.regexp_replace(F.lower(f), r"\s+", " ")))


def documents(parts: Column) -> Column:
    """array of struct(code, label, count, mandatory, source_text): what applicants have to send, by the first sentence that asks for each."""
    known = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])

    def asked(code: str, label: str, pattern: str) -> Column:
        counted = ascii_edges(r"(?i)\b(\d|two|three|four|one)\s+(?:\w+\s+){0,2}?(?=") + pattern.removeprefix("(?i)") + ")"

        def told(s: Column) -> Column:
            word = F.lower(F.regexp_extract(s, counted, 1))
            return F.struct(
                F.lit(code).alias("code"), F.lit(label).alias("label"), F.coalesce(F.try_element_at(known, word), word.try_cast("int")).alias("count"),
                F.when(s.rlike(MANDATORY), True).alias("mandatory"), F.substring(s, 1, 400).alias("source_text"),
            )

        return F.transform(F.slice(F.filter(parts, lambda s: s.rlike(pattern) & s.rlike(ASKED)), 1, 1), told)

    return F.flatten(F.array(*[asked(code, label, pattern) for code, (label, pattern) in DOCUMENTS.items()]))


def requirements(parts: Column) -> Column:
    """struct of what applicants need: english (each test), minimumDegree, minimumGpa, minimumGrade, requiredFields, documents, workExperienceYears, professionalRegistration, supervisorRequired, admissionOfferRequired."""
    english = F.struct(*[english_test(parts, t).alias(t) for t in ENGLISH])
    return F.struct(
        english.alias("english"), let(_first(parts, *DEGREE_HELD), degree).alias("minimumDegree"), minimum_gpa(parts).alias("minimumGpa"), minimum_grade(parts).alias("minimumGrade"),
        fields_of_study(parts).alias("requiredFields"), documents(parts).alias("documents"), work_years(parts).alias("workExperienceYears"),
        F.substring(_first(parts, REGISTERED), 1, 300).alias("professionalRegistration"), F.when(_first(parts, SUPERVISED).isNotNull(), True).alias("supervisorRequired"),
        F.when(_first(parts, ADMITTED).isNotNull(), True).alias("admissionOfferRequired"),
    )


#: Wording and names of funders, calls to apply, and addresses of targets.
FUNDER = ascii_edges(r"\b(?:funded\s+by|sponsored\s+by|in\s+partnership\s+with|offered\s+by|awarded\s+by|supported\s+by)\s+(?:the\s+)?([A-Z][A-Za-z&.,'-]*(?:\s+[A-Z][A-Za-z&.,'-]*){0,5})")
SCHEME = ascii_edges(r"(?i)\b(Chevening|Commonwealth|Fulbright|Erasmus\s*\+?|DAAD|Gates\s+Cambridge|Rhodes|Marshall|Mandela\s+Rhodes|MasterCard\s+Foundation|Schwarzman|Clarendon|Vanier|Endeavour)\b")
CALLS = _p(r"apply\s+now|apply\s+online|apply\s+here|start\s+your\s+application|make\s+an\s+application|application\s+form|submit\s+an\s+application|apply\s+for\s+this")
APPLY_URL = ascii_edges(r"(?i)/(?:apply|application|admissions?/apply|portal|forms?)\b|apply\.|applications?\.")
APPLYING = _p(r"appl(?:y|ication)")
TARGETS = {"PDF": r"(?i)\.pdf(?:\?|$)", "SCHOLARSHIP": r"(?i)scholarship|bursar|studentship|fellowship", "FUNDING": r"(?i)funding|financial|fees", "ADMISSIONS": r"(?i)admission|apply"}


def provider(text: Column, title: Column) -> Column:
    """Who funds an award: named in the text, else a known scheme in the title."""
    return F.coalesce(F.substring(F.regexp_replace(dates.first_match(text, FUNDER), "[.,]$", ""), 1, 150), dates.first_match(title, SCHEME))


def application_url(links: Column) -> Column:
    """The link that calls to apply, else one whose address and words speak of applying; never invented. links: array of struct(text, href, context)."""
    first = lambda f: F.try_element_at(F.filter(links, f), F.lit(1))["href"]
    return F.coalesce(first(lambda x: x["text"].rlike(CALLS)), first(lambda x: x["href"].rlike(APPLY_URL) & F.concat_ws(" ", x["text"], x["context"]).rlike(APPLYING)))


def target_type(url: Column) -> Column:
    """What a crawl target is likely to be, by its address."""
    return F.coalesce(*[F.when(url.rlike(pattern), kind) for kind, pattern in TARGETS.items()], F.lit("OTHER"))


def filled_fields(columns: list[Column]) -> Column:
    """How many of the columns hold something: not null, UNKNOWN, empty or [UNKNOWN]."""
    shown = [F.coalesce((c.cast("string") != "") & ~c.cast("string").isin("UNKNOWN", "[]", "[UNKNOWN]"), F.lit(False)).cast("int") for c in columns]
    return reduce(lambda a, b: a + b, shown, F.lit(0))
