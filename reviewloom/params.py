"""Parameters of a study: thresholds, dictionaries, label maps, word lists.

Everything here is small, driver-side configuration.  Operators take the pieces they need
as arguments, so a caller can replace any of them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

# ---------------------------------------------------------------------------------------
# Fixed values.  These have to be the published ones for results to agree.
# ---------------------------------------------------------------------------------------

BRAND_ORDER = ["H&M", "ZARA", "SHEIN", "Urban Outfitters"]

BRAND_SYNONYMS = {
    "H&M": "H&M",
    "HM": "H&M",
    "ZARA": "ZARA",
    "Zara": "ZARA",
    "SHEIN": "SHEIN",
    "Shein": "SHEIN",
    "Urban Outfitters": "Urban Outfitters",
    "URBAN OUTFITTERS": "Urban Outfitters",
}

EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_CORE = r"\d[\d\s().-]{7,}\d"
PHONE_PATTERN = rf"(?<!\d)(?:\+?{PHONE_CORE})"
EMAIL_MASK = "[REDACTED_EMAIL]"
PHONE_MASK = "[REDACTED_PHONE]"
MOJIBAKE_MARKS = "‚ÄÃâ"

ASPECTS = {
    "delivery_logistics": [
        "delivery", "delivered", "shipping", "parcel", "package", "courier", "dispatch",
        "tracking", "arrived", "late", "delay", "delayed", "order",
    ],
    "refunds_returns": [
        "refund", "refunded", "return", "returned", "exchange", "cancel", "cancelled",
        "voucher", "credit", "reimbursement",
    ],
    "customer_service": [
        "customer service", "support", "staff", "manager", "rude", "helpful", "response",
        "contact", "replied", "phone", "email", "chat",
    ],
    "product_quality": [
        "quality", "damaged", "defect", "defective", "broken", "cheap", "fabric", "sizing",
        "size", "fit", "material", "item",
    ],
    "in_store_experience": [
        "store", "in store", "fitting room", "queue", "cashier", "checkout",
        "shop assistant", "branch",
    ],
    "trust_reputation": [
        "scam", "fraud", "dishonest", "lied", "misleading", "trust", "never again", "avoid",
        "hate", "boycott",
    ],
}

EMOTIONS = {
    "anger": [
        "angry", "anger", "furious", "enraged", "annoyed", "ridiculous", "unacceptable",
        "outraged",
    ],
    "disgust": ["disgust", "disgusting", "gross", "revolting", "filthy", "appalling"],
    "disappointment": [
        "disappointed", "disappointing", "let down", "regret", "upset", "dissatisfied",
    ],
    "frustration": [
        "frustrating", "frustration", "impossible", "waiting", "useless", "unhelpful",
        "no response", "ignored",
    ],
}

STEM_MAP = {
    "deliveri": "delivery", "deliver": "delivery", "shipment": "shipping", "ship": "shipping",
    "onlin": "online", "wait": "waiting", "order": "order", "parcel": "parcel",
    "packag": "parcel", "arriv": "arrive", "deliv": "delivery", "receiv": "receive",
    "reciev": "receive", "return": "return", "refund": "refund", "cancel": "cancel",
    "qualiti": "quality", "product": "product", "item": "item", "size": "size",
    "servic": "service", "custom": "customer", "store": "store", "staff": "staff",
    "manag": "manager", "gift": "gift", "card": "card", "wrong": "wrong",
    "contact": "contact", "reply": "reply", "account": "account", "experi": "experience",
    "terribl": "terrible", "horribl": "horrible", "bad": "bad", "hate": "hate",
    "cloth": "clothes",
}

CUSTOM_STOPWORDS = [
    "zara", "shein", "hm", "hampm", "urban", "outfitters", "brand", "company", "wa", "ha",
    "thei", "thi", "that", "with", "from", "have", "still", "would", "could", "also", "dai",
    "said", "told", "ask", "asked", "just", "like", "bui", "buy", "compani", "experience",
    "bad", "worst", "terrible", "horrible", "poor", "time", "good", "realli", "look", "went",
    "monei",
]

LDA_LABELS = {
    0: "Payment, Vouchers & Website Issues",
    1: "Product Quality, Size & Wrong Items",
    2: "Gift Cards, Refunds & Payment Recovery",
    3: "Customer Service Failures & Staff Conduct",
    4: "Delivery, Non-Receipt & Shipping Delays",
    5: "Returns, Refunds & Service Recovery",
}

LDA_CONSTRUCTS = {
    0: ("Low Service Quality", "Voucher disputes, website problems, and purchase/payment friction reflect transactional low service quality."),
    1: ("Low Service Quality", "Wrong items, sizing problems, and product-quality complaints reflect fulfilment failure and poor purchase outcomes."),
    2: ("Negative Past Experience", "Gift-card disputes, refund problems, and payment recovery difficulties reflect repeated unresolved negative experience."),
    3: ("Low Service Quality", "Rude staff, poor support, and failed complaint handling indicate frontline customer-service breakdowns."),
    4: ("Low Service Quality", "Delivery delays, non-receipt, and parcel problems indicate logistics-related low service quality."),
    5: ("Negative Past Experience", "Returns, refund disputes, and repeated contact attempts indicate unresolved recovery failure and accumulated negative past experience."),
}

# Rules are tried in this order; the first one with a needle inside the raw label wins.
LABEL_RULES = [
    ("Shipping Delays & Online Fulfilment", ["shipped", "order online", "ship"]),
    ("In-Store Staff, Policy & Queue Problems", ["manager", "receipt", "worst customer", "queue"]),
    ("SHEIN Logistics, Replies & Account Issues", ["evri", "returned items", "account", "shein"]),
    ("Order Cancellation & Fulfilment Breakdown", ["order cancelled", "cancelled order"]),
    ("Poor Quality & Cheap Products", ["quality", "cheap", "jeans", "pair"]),
    ("Premium Delivery & Courier Failure", ["day delivery", "hermes", "paid day"]),
    ("Non-Delivery & Missing Parcel", ["didnt receive", "receive order", "did receive", "received order", "haven received"]),
    ("Gift Card & Store Credit Issues", ["gift", "gift card", "credit"]),
    ("Wrong Item & Wrong Size", ["wrong item", "wrong size", "sent wrong"]),
    ("Severe Service Failure", ["terrible customer", "terrible service"]),
    ("Bad Experience & Negative Engagement", ["bad experience", "service bad", "really bad"]),
    ("Mixed Negative Complaints", ["absolutely", "clothes"]),
]

LABEL_CONSTRUCTS = {
    "Mixed Negative Complaints": ("Negative Past Experience", "The outlier cluster captures diffuse but repeated negative complaints that often reflect accumulated poor experiences."),
    "Shipping Delays & Online Fulfilment": ("Low Service Quality", "Shipping and fulfilment delays indicate operational low service quality in online ordering."),
    "In-Store Staff, Policy & Queue Problems": ("Low Service Quality", "Store manager, receipt, and policy issues reflect in-store service quality breakdowns."),
    "SHEIN Logistics, Replies & Account Issues": ("Negative Past Experience", "Repeated SHEIN-specific logistics and reply failures indicate accumulated negative past experiences."),
    "Order Cancellation & Fulfilment Breakdown": ("Negative Past Experience", "Order cancellation problems reflect unresolved service failures that accumulate into negative experience."),
    "Poor Quality & Cheap Products": ("Low Service Quality", "Poor product quality and cheapness reflect core product-related service failure."),
    "Premium Delivery & Courier Failure": ("Low Service Quality", "Premium delivery and courier failure indicate unmet service promises and logistics breakdown."),
    "Non-Delivery & Missing Parcel": ("Negative Past Experience", "Non-delivery and missing parcels often reflect repeated unresolved failures and heightened consumer memory of harm."),
    "Gift Card & Store Credit Issues": ("Low Service Quality", "Gift-card and store-credit disputes indicate payment and restitution service failures."),
    "Wrong Item & Wrong Size": ("Low Service Quality", "Wrong-item and wrong-size complaints reflect fulfilment and product-quality failures."),
    "Severe Service Failure": ("Brand Hate", "Highly severe complaint language signals strong aversive emotion approaching brand hate."),
    "Bad Experience & Negative Engagement": ("Brand Hate", "Explicitly hostile bad-experience narratives indicate an emergent aversive response consistent with brand hate."),
}

PUBLIC_COLUMNS = [
    "brand", "address", "reviewer_country", "reviewer_published_date", "review_title",
    "review_text", "reviewer_rating", "compound", "pos", "neg", "neu", "sentiment_label",
    "aspect_top_category", "emotion_top_category", "dominant_topic_id",
    "dominant_topic_label", "dominant_topic_publication_label", "bertopic_topic_id",
    "bertopic_topic_label", "bertopic_topic_publication_label",
]

# source column -> name in the publication export, in export order
EXPORT_COLUMNS = {
    "brand": "brand",
    "reviewer_country": "reviewer_country",
    "reviewer_published_date": "reviewer_published_date",
    "review_title": "review_title",
    "review_text": "review_text",
    "reviewer_rating": "reviewer_rating",
    "compound": "sent_compound",
    "pos": "sent_pos",
    "neg": "sent_neg",
    "neu": "sent_neu",
    "sentiment_label": "sentiment_label",
    "dominant_topic_id": "lda_topic",
    "dominant_topic_publication_label": "lda_topic_label",
    "bertopic_topic_id": "bertopic_topic",
    "bertopic_topic_publication_label": "bertopic_topic_label",
    "aspect_top_category": "aspect_top_category",
    "emotion_top_category": "emotion_top_category",
}

# ---------------------------------------------------------------------------------------
# Defaults of our own.
# ---------------------------------------------------------------------------------------

# Tried in this order.  The first covers dates and ISO timestamps in one go, so that common inputs
# do not fail through a list of formats.
DATE_FORMATS = [
    "yyyy-MM-dd[['T'][ ]HH:mm[:ss[.SSSSSSSSS]][XXX]]",
    "yyyy-MM-dd['T'][ ]HH:mm[:ss[.SSSSSSSSS]]xx",
    "yyyy/MM/dd[ HH:mm[:ss]]",
    "yyyyMMdd",
    "d-MMM-yyyy",
    "M/d/yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
]

# Word valences, negators and boosters follow the published list of Hutto & Gilbert (2014), in part.
# A starter lexicon only, so that a study runs out of the box; a real run passes a full
# published valence lexicon (see sources.reviews.read_lexicon).
STARTER_LEXICON = {
    "amazing": 2.8, "angry": -2.3, "annoyed": -1.6, "appalling": -1.5, "awful": -2.0,
    "bad": -2.5, "best": 3.2, "broken": -2.1, "cancelled": -1.0, "damaged": -1.9,
    "disappointed": -1.9, "disappointing": -2.2, "disgusting": -2.4, "dishonest": -2.7,
    "easy": 1.9, "excellent": 2.7, "fraud": -2.8, "fun": 2.3, "furious": -2.7, "good": 1.9,
    "great": 3.1, "happy": 2.7, "hate": -2.7, "help": 1.7, "helpful": 1.8, "horrible": -2.5,
    "ignored": -1.3, "kind": 2.4, "lied": -1.6, "love": 3.2, "misleading": -1.7, "nice": 1.8,
    "perfect": 2.7, "pleased": 1.9, "poor": -2.1, "problem": -1.7, "regret": -1.8,
    "ridiculous": -1.5, "rude": -2.0, "sad": -2.1, "scam": -2.7, "terrible": -2.1,
    "trust": 2.3, "unhappy": -1.8, "upset": -1.6, "useless": -1.8, "waste": -1.8,
    "worst": -3.1, "worthless": -1.9, "wrong": -2.1,
}
NEGATORS = [
    "aint", "ain't", "arent", "aren't", "cannot", "cant", "can't", "couldnt", "couldn't",
    "didnt", "didn't", "doesnt", "doesn't", "dont", "don't", "hadnt", "hadn't", "hasnt",
    "hasn't", "havent", "haven't", "isnt", "isn't", "neither", "never", "no", "none", "nor",
    "not", "nothing", "nowhere", "shouldnt", "shouldn't", "wasnt", "wasn't", "werent",
    "weren't", "without", "wont", "won't", "wouldnt", "wouldn't",
]
BOOSTERS = {
    "absolutely": 0.293, "completely": 0.293, "extremely": 0.293, "highly": 0.293,
    "incredibly": 0.293, "more": 0.293, "most": 0.293, "really": 0.293, "so": 0.293,
    "totally": 0.293, "very": 0.293, "almost": -0.293, "barely": -0.293, "hardly": -0.293,
    "less": -0.293, "slightly": -0.293, "somewhat": -0.293,
}


@dataclass(frozen=True)
class Params:
    """One study's settings.  ``stopwords=None`` means Spark's built-in English list."""

    brand_order: list[str] = field(default_factory=lambda: list(BRAND_ORDER))
    brand_synonyms: dict[str, str] = field(default_factory=lambda: dict(BRAND_SYNONYMS))
    min_star: float = 1
    max_star: float = 3
    min_tokens: int = 5
    seed: int = 42
    lda_topics: int = 6
    lda_iterations: int = 10
    top_words: int = 10
    cluster_top_words: int = 10
    max_features: int = 2500
    min_df: int = 5
    max_df: float = 0.85
    embedding_dim: int = 100
    min_topic_size: int = 75
    cluster_method: str = "reach"  # one reach, eps; or "hierarchy", clusters of differing density
    eps: float = 0.6
    min_pts: int = 5
    frequent_words: int = 50_000  # looked up by broadcast, some 3 MB; other words by a join
    positive_threshold: float = 0.05
    negative_threshold: float = -0.05
    coherence_window: int = 110
    date_formats: list[str] = field(default_factory=lambda: list(DATE_FORMATS))
    aspects: dict[str, list[str]] = field(default_factory=lambda: dict(ASPECTS))
    emotions: dict[str, list[str]] = field(default_factory=lambda: dict(EMOTIONS))
    stopwords: list[str] | None = None
    custom_stopwords: list[str] = field(default_factory=lambda: list(CUSTOM_STOPWORDS))
    stem_map: dict[str, str] = field(default_factory=lambda: dict(STEM_MAP))
    lexicon: dict[str, float] = field(default_factory=lambda: dict(STARTER_LEXICON))
    negators: list[str] = field(default_factory=lambda: list(NEGATORS))
    boosters: dict[str, float] = field(default_factory=lambda: dict(BOOSTERS))
    lda_labels: dict[int, str] = field(default_factory=lambda: dict(LDA_LABELS))
    lda_constructs: dict[int, tuple[str, str]] = field(default_factory=lambda: dict(LDA_CONSTRUCTS))
    label_rules: list[tuple[str, list[str]]] = field(default_factory=lambda: list(LABEL_RULES))
    label_constructs: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(LABEL_CONSTRUCTS))

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)


def _parse(path: str) -> dict:
    with open(path, encoding="utf-8") as handle:
        if not path.endswith((".yml", ".yaml")):
            return json.load(handle)
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading YAML parameters needs PyYAML; use JSON instead") from error
        return yaml.safe_load(handle)


# names inside the "analysis" section -> field names, where they differ
SECTION_NAMES = {
    "random_state": "seed",
    "lda_top_words": "top_words",
    "bertopic_top_words": "cluster_top_words",
    "bertopic_min_topic_size": "min_topic_size",
    "bertopic_embedding_dim": "embedding_dim",
}


def from_sections(sections: dict) -> dict:
    """Fields from a file in sections: ``analysis``, ``sentiment``, ``aspects``, ``emotions``,
    ``publication_labels.lda`` and ``construct_mapping.lda``.  Other sections do not affect results."""
    given = {SECTION_NAMES.get(k, k): v for k, v in sections.get("analysis", {}).items()}
    given |= sections.get("sentiment", {})
    given |= {k: sections[k] for k in ("aspects", "emotions") if k in sections}
    if "lda" in sections.get("publication_labels", {}):
        given["lda_labels"] = sections["publication_labels"]["lda"]
    if "lda" in sections.get("construct_mapping", {}):
        given["lda_constructs"] = {
            k: (v.get("primary_construct", ""), v.get("interpretation", ""))
            for k, v in sections["construct_mapping"]["lda"].items()
        }
    return given


def load_params(path: str) -> Params:
    """Read JSON or YAML: field names of :class:`Params`, or the sections of :func:`from_sections`.
    What is not given keeps its default."""
    given = _parse(path)
    if "analysis" in given:
        given = from_sections(given)
    unknown = set(given) - {f.name for f in fields(Params)}
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    for key in ("lda_labels", "lda_constructs"):
        if key in given:
            given[key] = {int(k): tuple(v) if isinstance(v, list) else v for k, v in given[key].items()}
    return Params(**given)


def english_stopwords(params: Params) -> list[str]:
    """The raw-token stopword list of a study."""
    if params.stopwords is not None:
        return list(params.stopwords)
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")
