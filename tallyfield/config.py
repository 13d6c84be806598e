"""Thresholds of the review engine; every operator takes them from here by default.

The values in this file are fixed: they define the results.
"""

from __future__ import annotations

#: Usage cohorts by minutes, from the first bound up to but not including the second.
BUCKETS = [("refund_window", 0, 120), ("early", 120, 1200), ("mid", 1200, 6000), ("veteran", 6000, None)]
BUCKET_NAMES = [name for name, _, _ in BUCKETS]
UNKNOWN = "unknown"

MIN_SURVIVORS = 20  # fewer mute a cohort
MEAN_BUCKETS = ["early", "mid", "veteran"]
MEAN_MIN_POOL = 30
BUY_AT, SKIP_BELOW = 89.0, 64.0
RECENT_DAYS = 365

DIVERGENCE_MIN_POOL, DIVERGENCE_MIN_GAP, SHAPE_TOLERANCE = 30, 25.0, 3.0
RECENT_MIN_POOL, RECENT_MIN_SHIFT, OLDER_MIN_POOL = 150, 8.0, 100

HEARTS, HEART_DENSITY, FUNNY_FLOOR = 3, 0.02, 2
MIN_WORDS, ALPHA_RATIO, REPEAT_RATIO = 5, 0.6, 0.35
DISPROPORTIONATE = 10.0
SHIFT_WARN, SHIFT_MIN_N = 3.0, 30

MIN_UNION_COVERAGE, MIN_CITATION_COVERAGE, MIN_CITATIONS = 0.25, 0.10, 2
MERGE_OVERLAP = 0.5
THIN_REVIEWERS, ALPHA = 4, 0.05 / 1077
BALANCE_AVAILABLE, BALANCE_CITED = 10, 5

REVIEW_FLOOR, CORE_FLOOR = 70, 1000
VETERAN_SHARE_MAX, MIN_ELIGIBLE = 0.60, 2
CITATION_CHARS, PROMPT_CHARS = 2000, 1500

#: Statuses of a run that has ended; any other counts as active, so that new ones do.
ENDED = ["completed"]
DAILY_REQUESTS, LIVE_RESERVE, FLASH_DAILY = 500, 100, 20
#: Outcomes that settle a title.
FINAL = ["ok", "thin_segmentation", "qr4_failed"]
REQUESTS_PER_MINUTE, RESERVED, DAILY_BUDGET, HOURLY_PER_IP = 12, 13, 400, 5
PRUNE_AFTER_HOURS = 48
PACIFIC = "America/Los_Angeles"

#: Words without content for the grounding check.
STOPWORDS = set(
    """
a an the and or but if then than that this these those is are was were be been being am
of in on at to for with from by as it its into about over under out up down off not no nor
so such can could will would should may might must do does did done have has had having
you your yours they them their there here what which who whom when where why how
i we he she his her hers our ours us me my mine your just also even still very too
one two three first second next last other others another same own each both all any some
game games gaming player players playing play plays played review reviews reviewer reviewers
steam hour hours get gets got getting make makes made making like likes liked really much
many lot lots thing things time times way ways bit really pretty good bad great
""".split()
)
#: Groups of people, for the prevalence guard.
CROWD = r"(?:players?|people|reviewers?|users?|buyers?|gamers?|everyone|the community|folks|fans?)"
#: Patterns of the prevalence guard with their labels.
PREVALENCE = [
    (r"\d+\s?%", "percentage"),
    (r"\b\d+\s+(?:out\s+of|in)\s+\d+\b", "ratio"),
    (r"\b(?:one|two|three|four|nine)[- ](?:in|out\s+of)[- ]\w+\b", "ratio in words"),
    (r"(?<!the )\bmost\b(?!\s+(?:polished|fun|important|common\s+complaint))", "quantifier over people"),
    (r"\bmajority\b", "quantifier over people"),
    (r"\bminority\b", "quantifier over people"),
    (r"\bmany\s+" + CROWD, "quantifier over people"),
    (r"\bfew\s+" + CROWD, "quantifier over people"),
    (r"\bvery\s+few\b", "quantifier over people"),
    (r"\bsome\s+" + CROWD, "quantifier over people"),
    (r"\bseveral\s+" + CROWD, "quantifier over people"),
    (r"\bnumerous\b|\bcountless\b|\bplenty\s+of\s+" + CROWD, "quantifier over people"),
    (r"\bhalf\s+(?:of\s+)?(?:the\s+)?" + CROWD, "proportion"),
    (r"\b(?:a\s+)?(?:third|quarter|fifth)\s+of\b", "proportion"),
    (r"\b(?:all|every|everyone|nobody|no\s+one|none)\s*" + CROWD + r"?\b(?!\s+(?:mission|level|run))", "absolute quantifier"),
    (r"\bconsensus\b|\bunanimous\b", "consensus language"),
    (r"\bmore\s+" + CROWD + r"\s+(?:than|report|say|complain)", "group comparison"),
    (r"\b(?:vast|large|small)\s+(?:number|proportion|share|chunk)\b", "proportion"),
]
#: Names of platforms and versions whose digits are no quantities.
PLATFORM = (
    r"(?i)\b(?:Windows|DirectX|OpenGL|Vulkan|macOS|OS\s?X|iOS|Android|Linux|RTX|GTX|Radeon|GeForce|Ryzen|Core\s+i|Steam\s+Deck|DLSS|FSR|"
    r"PlayStation|PS|Xbox)\s?\d+[a-z]*\b"
)
#: Characters read as letters before the word lists are matched, and the letters.
LEET_FROM, LEET_TO = "013457@$", "oieastas"
#: Endings that a blocked stem may take.
SUFFIX = r"(?:s|es|d|ed|ing|er|ers|y|ies)?"

#: Limits of a document's header, and the phrases that argue with its verdict or make friction a condition.
TAGLINE_CHARS, CLAUSE_CHARS, FIT_CLAUSES = 90, 80, (2, 4)
SKIP_LANGUAGE = r"(?i)\b(?:should\s+skip|skip\s+(?:it|this)|avoid\s+(?:it|this)|should\s+avoid|steer\s+clear)\b"
BUY_LANGUAGE = r"(?i)\b(?:should\s+buy|buy\s+(?:it|this|in)|pick\s+(?:it|this)\s+up|worth\s+buying)\b"
FRICTION_VERBS = r"tolerate|overlook|navigate|manage|troubleshoot|weather|endure|put\s+up\s+with"
FRICTION = (
    rf"(?i)\b(?:(?:willing|prepared|happy)\s+to\s+(?:{FRICTION_VERBS})|(?:must|have\s+to|need\s+to)\s+(?:{FRICTION_VERBS}|accept)|"
    r"can\s+tolerate|if\s+you\s+can\s+overlook|provided\s+you\s+(?:accept|can))\b"
)
#: Parts of a failed request's message.
REFUSED = ["401", "UNAUTHENTICATED", "PERMISSION_DENIED"]
TOO_MANY = ["429", "RESOURCE_EXHAUSTED"]
TRANSIENT = ["503", "UNAVAILABLE", "500", "INTERNAL", "504", "DEADLINE"]
DAY_QUOTA = "PerDay"
#: Sentences in which a word is tried on the prevalence guard.
CARRIERS = ["the game has %s problems", "%s players report problems"]
#: After so long a request that no run answered counts as lost.
DISPATCH_GRACE_SECONDS = 90
#: Points below the pool that the summary of deltas counts at, or below.
DELTA_THRESHOLDS = [40, 50, 60]
