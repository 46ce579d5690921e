"""Names, limits and formats that results depend on."""

# --- fixed values: the 27 emotion labels, in label order --------------------
EMOTIONS = [
    "admiration",
    "amusement",
    "anger",
    "annoyance",
    "approval",
    "caring",
    "confusion",
    "curiosity",
    "desire",
    "disappointment",
    "disapproval",
    "disgust",
    "embarrassment",
    "excitement",
    "fear",
    "gratitude",
    "grief",
    "joy",
    "love",
    "nervousness",
    "optimism",
    "pride",
    "realization",
    "relief",
    "remorse",
    "sadness",
    "surprise",
]

# --- fixed values: facets of the two reviews, in report order ---------------
SWOT_FACETS = ["positive", "negative"]
PESTLE_FACETS = [
    "politics",
    "economics",
    "social",
    "technology",
    "legal",
    "environment",
]
PESTLE_TITLES = {
    "politics": "Political",
    "economics": "Economic",
    "social": "Social",
    "technology": "Technological",
    "legal": "Legal",
    "environment": "Environmental",
}

# --- fixed values: topic groups of the article search form ------------------
TOPIC_GROUPS = {
    "business": ["politic", "business", "finance", "economy"],
    "mainstream": ["news"],
    "science": ["science", "energy", "tech"],
    "culture": [
        "food",
        "world",
        "entertainment",
        "travel",
        "gaming",
        "music",
        "beauty",
    ],
}

# --- fixed values: texts that stand for a removed or missing post -----------
PLACEHOLDERS = ["nan", "[deleted]", "[removed]"]

# --- fixed values: sizes ------------------------------------------------------
PAGE_SIZE = 100
MAX_RANK = 5000
SWOT_ARTICLES_K = 30
SWOT_POSTS_K = 30
SWOT_TWEETS_K = 20
PESTLE_K = 60
DOMINANT_THRESHOLD = 1000
DOMINANT_K = 10
PREVIEW_CHARS = 175
WINDOW_DAYS = 7
NEIGHBOURS = 8
ENCODER_DIMS = 384
SIMILAR_TAKE = 4


def palette_rows() -> list[tuple[str, str]]:
    """Default colours: hues spread evenly over the labels."""
    import colorsys

    rows = []
    for i, emotion in enumerate(EMOTIONS):
        rgb = colorsys.hls_to_rgb(i / len(EMOTIONS), 0.45 + 0.15 * (i % 2), 0.8)
        rows.append((emotion, "#" + "".join(f"{round(255 * v):02X}" for v in rgb)))
    return rows
