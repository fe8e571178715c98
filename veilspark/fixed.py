"""Fixed values that results depend on.

These are stated plainly and together; operators take them as defaults and
every one of them can be overridden by a parameter.
"""

# --- fixed values: PII type names (11) -------------------------------------
PII_TYPES = (
    "PHONE_NUMBER",
    "EMAIL_ADDRESS",
    "PERSON",
    "LOCATION",
    "DATE_TIME",
    "NRP",
    "IP_ADDRESS",
    "CREDIT_CARD",
    "US_BANK_NUMBER",
    "US_PASSPORT",
    "US_SSN",
)

# --- fixed values: entity resolution modes ---------------------------------
EQUALITY = "EQUALITY"
CONTAINMENT = "CONTAINMENT"

# --- fixed values: token delimiter -----------------------------------------
TOKEN_DELIM = "α"  # Greek small letter alpha

# --- fixed values: request assembly texts ----------------------------------
RAG_SYSTEM_PROMPT = (
    "Ensure that all placeholders, including those inside quotes, are enclosed by "
    "the greek letter alpha (α), exactly as I have done in this prompt. You MUST use "
    "the greek letter (α) to indicate placeholders. Use the context below to help "
    "answer the question and follow the desired format accurately."
)
CONTEXT_LINE = "From the document with the title {title}, {content}"
CONTEXT_HEAD = "Below is useful context. Do not answer the question yet.\n"
CONTEXT_TAIL = "\n---\n"

# --- fixed values: toxicity purge sentence ---------------------------------
PURGED_TEXT = "This text used to contain offensive material, and was thus purged"

# --- fixed values: English stop words (Spark's own list, in its order) -------
STOP_WORDS = tuple((
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her "
    "hers herself it its itself they them their theirs themselves what which who whom this that these "
    "those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so than too very s "
    "t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd "
    "they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't "
    "weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't "
    "couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's "
    "would "
).split())

# --- fixed values: defaults -------------------------------------------------
DEFAULT_THRESHOLD = 0.5          # PII score threshold
DEFAULT_MIN_CHUNK = 3            # words; shorter pieces join but emit nothing
DEFAULT_OVERLAP = 10             # words
DEFAULT_K = 5                    # k-NN default
RAG_K = 3                        # k per title in the request path
CACHE_THRESHOLD = 0.1            # miss when score >= this
CACHE_TTL_SECONDS = 604800       # 7 days
ALIAS_LEN = 12                   # characters of a short alias: 72 bits, so that no two of a session meet

# Python's str.split() whitespace set, as characters and as one regex
# character class that Java regex and RE2 read the same way.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
WS_CLASS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in WS_CHARS) + "]"
WORD_RX = "[^" + WS_CLASS[1:] + "+"   # a maximal run of non-blanks
