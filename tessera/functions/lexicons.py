"""Word lists and rule constants.

FIXED VALUES — these must equal the behaviour being reproduced; they are
stated plainly, in natural order, and are only ever passed as parameters.
"""

# ---- FIXED VALUES: review-mart word-set scorer (T1) -----------------------
MART_POSITIVE = ("love", "great", "excellent", "perfect", "recommend", "amazing")
MART_NEGATIVE = ("disappointed", "poor", "broken", "terrible", "bad", "worst")

# ---- FIXED VALUES: substring sentiment rules (T2, T3, T5) -----------------
RULE_POSITIVE = ("love", "amazing", "excellent", "great", "fantastic",
                 "wonderful", "best", "perfect", "exceeded", "recommend")
RULE_NEGATIVE = ("terrible", "awful", "worst", "horrible", "disappointed",
                 "broken", "refund", "frustrated", "slow", "damaged")

# aspect name -> (keywords, base score)
ASPECT_GROUPS = (
    ("product quality", ("quality", "build", "material", "durable", "solid", "premium"), 0.85),
    ("shipping speed", ("shipping", "delivery", "arrived", "transit", "slow", "fast"), 0.78),
    ("customer service", ("service", "support", "agent", "response", "help", "call"), 0.80),
    ("value for money", ("price", "value", "expensive", "cheap", "overpriced", "worth"), 0.75),
    ("user experience", ("easy", "intuitive", "confusing", "app", "interface", "feature"), 0.72),
    ("packaging", ("packaging", "box", "wrapped", "damaged", "unboxing"), 0.70),
)

# dictionary entities, typed PRODUCT (T4)
PRODUCT_ENTITIES = ("iPhone", "MacBook", "AirPods", "Galaxy", "Pixel", "Surface")

# urgency escalation terms (T5)
CRITICAL_TERMS = ("refund", "legal")
HIGH_TERMS = ("complaint",)

# punctuation replaced by spaces before tokenising
TOKEN_PUNCTUATION = ".,!?;:\"'()[]"
# characters stripped from both ends of a key phrase
PHRASE_STRIP = ".,!?;:"

# label names of the multi-label text model
SENTIMENT_LABELS = ("sentiment:positive", "sentiment:negative", "sentiment:mixed")

# ---- FIXED VALUES: customer-360 rules (C1-C3) -----------------------------
COMPLAINT_TERMS = ("complaint", "frustrated")
RETURN_TERM = "return"

# ---- FIXED VALUES: k-means segment names by monetary rank (W5) ------------
SEGMENT_NAMES = ("High-Value Collector", "Brand Loyalist", "Value Seeker",
                 "Gifting Shopper", "Casual Browser")

# ---- FIXED VALUES: quality gates (M16) -------------------------------------
QUALITY_GATES = (
    ("churn_auc_roc", ">=", 0.70),
    ("churn_f1", ">=", 0.55),
    ("segmentation_silhouette", ">=", 0.30),
    ("demand_mape", "<=", 30.0),
)

# ---- Our default stop words for keyword edge search (G6; a parameter) -------
GRAPH_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
                   "in", "is", "it", "of", "on", "or", "that", "the", "to",
                   "what", "which", "with", "show", "me", "find", "products")

# ---- Lexicon for the driver's invented-word prose ---------------------------
# Each word is a whole word in a few hundred English documents; ``thin`` is a
# substring of ``thing`` so word matching (T1) and substring matching
# give different answers on real rows.
DRIVER_POSITIVE = ("thing", "erth", "attion", "ered", "thly")
DRIVER_NEGATIVE = ("erly", "thin", "eror", "erwh", "thst")

# ---- FIXED VALUES: prompt line around a text's context (T12) ---------------
CONTEXT_LINE = ("BUSINESS CONTEXT: This is a ", ".\n")
RECIPE_RELATION = "OFTEN_IN_SAME_RECIPE"
