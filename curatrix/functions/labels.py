"""Label taxonomy and label columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The training classes, in order of their ids.
CLASSES = ["clean", "topic_crypto", "scam"]
# Raw labels that make a post a scam.
SCAM_LABELS = [
    "phishing", "malware", "fake_support", "recovery_scam", "job_scam", "romance_scam", "impersonation", "account_compromise",
    "spam", "reply_spam", "dm_spam", "promo", "affiliate", "lead_gen", "engagement_bait", "follow_train", "giveaway", "bot",
    "scam", "crypto_scam",
]
# Labels that a relabelling may set.
CHANGE_LABELS = ["clean", "topic_crypto", "scam", "promo", "ai_generated_reply"]
# Ids of published labels.
PUBLISHED_IDS = {"clean": 0, "topic_crypto": 1, "scam": 2, "ai_generated_reply": 3, "promo": 4}
# The taxonomy, by group.
TAXONOMY = {
    "base": ["clean"],
    "security_fraud": ["scam", "phishing", "malware", "impersonation", "fake_support", "recovery_scam", "job_scam", "romance_scam", "account_compromise"],
    "spam_manipulation_commercial": [
        "spam", "reply_spam", "dm_spam", "promo", "affiliate", "lead_gen", "engagement_bait", "follow_train", "giveaway",
        "platform_manipulation", "astroturf", "bot", "ai_generated", "ai_generated_reply", "ai_slop", "content_farm", "copypasta",
        "stolen_content", "clickbait", "low_effort", "vaguepost", "ragebait",
    ],
    "information_integrity": ["misinformation", "civic_misinfo", "manipulated_media", "conspiracy", "pseudoscience"],
    "safety_sensitive": [
        "hate", "harassment", "threat_violence", "violent_extremism", "graphic_violence", "self_harm", "adult_nudity",
        "nonconsensual_nudity", "child_exploitation", "illegal_goods", "privacy_doxxing", "profanity",
    ],
    "topic_filters_optional": [
        "topic_news", "topic_world_news", "topic_local_news", "topic_war_conflict", "topic_crime_truecrime", "topic_disasters_tragedy",
        "topic_law_courts", "topic_environment_climate", "topic_social_issues", "topic_politics", "topic_elections", "topic_finance",
        "topic_investing", "topic_personal_finance", "topic_crypto", "topic_real_estate", "topic_shopping_deals",
        "topic_marketing_advertising", "topic_gambling", "topic_technology", "topic_ai", "topic_cybersecurity", "topic_programming_dev",
        "topic_startups_vc", "topic_consumer_electronics", "topic_entertainment", "topic_tv_movies", "topic_music", "topic_books",
        "topic_anime_manga", "topic_gaming", "topic_esports", "topic_celebrity", "topic_celebrity_gossip", "topic_comedy_memes",
        "topic_health", "topic_nutrition_diet", "topic_fitness", "topic_mental_health", "topic_beauty_fashion", "topic_food_drink",
        "topic_travel", "topic_home_garden", "topic_family_parenting", "topic_relationships_dating", "topic_sports", "topic_religion",
        "topic_adult_services", "topic_language_other",
    ],
    "special_modes": ["spoiler"],
}


def constants(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def labels_dim(spark: SparkSession) -> DataFrame:
    """(label, label_group) of the taxonomy."""
    return spark.createDataFrame([(label, group) for group, labels in TAXONOMY.items() for label in labels], "label string, label_group string")


def _trimmed(labels: Column) -> Column:
    return F.filter(F.transform(labels, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))


def raw_labels(labels: str = "labels", label: str = "label", mode: str = "list_first") -> Column:
    """Trimmed lower-case labels. list_first: of the list if there is one, else of the single label. union: both, each once."""
    listed, single = F.col(labels), F.array(F.col(label))
    if mode == "list_first":
        return F.when(listed.isNotNull(), _trimmed(listed)).otherwise(_trimmed(single))
    return F.array_distinct(_trimmed(F.concat(F.coalesce(listed, F.array().cast("array<string>")), single)))


def collapse_label(raw: Column) -> Column:
    """scam before topic_crypto before clean."""
    topic = F.array_contains(raw, "topic_crypto") | F.array_contains(raw, "crypto")
    return F.when(F.arrays_overlap(raw, constants(SCAM_LABELS)), "scam").when(topic, "topic_crypto").otherwise("clean")


def multi_labels(raw: Column) -> Column:
    """The sorted set of topic_crypto and scam, or clean alone."""
    topic = F.array_contains(raw, "topic_crypto") | F.array_contains(raw, "crypto")
    found = F.array_compact(F.array(F.when(F.arrays_overlap(raw, constants(SCAM_LABELS)), F.lit("scam")), F.when(topic, F.lit("topic_crypto"))))
    return F.when(F.size(found) > 0, found).otherwise(constants(["clean"]))


def training_targets(raw: Column, topics: list[str]) -> Column:
    """struct(collapsed, y_scam, y_topics); a topic's bit is set if `topic_x` or `x` is among the labels."""
    collapsed = collapse_label(raw)
    bits = [(F.array_contains(raw, t) | F.array_contains(raw, t.removeprefix("topic_"))).cast("int") for t in topics]
    return F.struct(collapsed.alias("collapsed"), (collapsed == "scam").cast("int").alias("y_scam"), F.array(*bits).alias("y_topics"))


def normalize_change_labels(labels: Column) -> Column:
    """crypto_scam is two labels, crypto an alias; unknown ones go, each once; clean only by itself."""
    opened = F.flatten(F.transform(labels, lambda x: F.when(x == "crypto_scam", constants(["topic_crypto", "scam"])).when(x == "crypto", constants(["topic_crypto"])).otherwise(F.array(x))))
    known = F.array_distinct(F.filter(opened, lambda x: x.isin(CHANGE_LABELS)))
    return F.when(F.size(known) > 1, F.array_remove(known, "clean")).otherwise(known)


def feature_tokens(labels: Column) -> Column:
    """L:label for each label, and P:a|b for each pair in order."""
    ordered = F.array_sort(labels)
    singles = F.transform(ordered, lambda x: F.concat(F.lit("L:"), x))
    pairs = F.flatten(F.transform(ordered, lambda a, i: F.transform(F.slice(ordered, i + 2, F.size(ordered)), lambda b: F.concat(F.lit("P:"), a, F.lit("|"), b))))
    return F.concat(singles, pairs)


def publishable(labels: str = "labels", label: str = "label") -> Column:
    """struct(labels, label_ids): labels once each in order; unknown ones have no id."""
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(PUBLISHED_IDS.items())])
    found = F.array_distinct(F.when(F.col(labels).isNotNull(), F.col(labels)).otherwise(F.array_compact(F.array(label))))
    return F.struct(found.alias("labels"), F.filter(F.transform(found, lambda x: F.try_element_at(lookup, x)), lambda x: x.isNotNull()).alias("label_ids"))
