"""The enumerations of records, in their listed order."""

DEGREE_LEVELS = ("BACHELORS", "MASTERS", "PHD", "POSTDOC", "DIPLOMA", "CERTIFICATE", "RESEARCH_FELLOWSHIP")
STUDY_MODES = ("ON_CAMPUS", "ONLINE", "HYBRID", "DISTANCE", "UNKNOWN")
ATTENDANCE_MODES = ("FULL_TIME", "PART_TIME", "BOTH", "UNKNOWN")
DELIVERY_MODES = ("IN_PERSON", "REMOTE", "MIXED", "UNKNOWN")
FUNDING_TYPES = (
    "FULLY_FUNDED", "PARTIALLY_FUNDED", "TUITION_ONLY", "TUITION_PLUS_STIPEND", "LIVING_STIPEND", "RESEARCH_FUNDING", "TRAVEL_GRANT", "ACCOMMODATION",
    "APPLICATION_FEE_WAIVER", "MERIT_BASED", "NEED_BASED", "SPORTS", "GOVERNMENT", "UNIVERSITY", "EXTERNAL", "FELLOWSHIP", "UNKNOWN",
)
STATUSES = ("DISCOVERED", "UNDER_REVIEW", "VERIFIED", "UPCOMING", "OPEN", "CLOSING_SOON", "CLOSED", "EXPIRED", "REPLACED")
#: From the most to the least authoritative.
SOURCE_TYPES = ("UNIVERSITY", "GOVERNMENT", "PROVIDER", "FACULTY", "INSTITUTIONAL", "AGGREGATOR", "PDF", "OTHER")
