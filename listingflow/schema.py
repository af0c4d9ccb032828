"""The canonical listing columns and the default profiles that fill them."""

from pyspark.sql import types as T

LISTING = T.StructType([
    T.StructField("listing_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("deadline", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("eligibility", T.StringType()),
    T.StructField("organization", T.StringType()),
    T.StructField("org_website", T.StringType()),
    T.StructField("academic_level", T.StringType()),
    T.StructField("geographic_restrictions", T.StringType()),
    T.StructField("target_type", T.StringType()),
    T.StructField("ethnicity", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("min_award", T.DecimalType(10, 2)),
    T.StructField("max_award", T.DecimalType(10, 2)),
    T.StructField("renewable", T.BooleanType()),
    T.StructField("country", T.StringType()),
    T.StructField("apply_url", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("essay_required", T.BooleanType()),
    T.StructField("recommendations_required", T.BooleanType()),
    T.StructField("source", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("src_seq", T.LongType()),
])

# One item of a key-value export; any field may be absent.
EXPORT_ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("deadline", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("eligibility", T.StringType()),
    T.StructField("organization", T.StringType()),
    T.StructField("academicLevel", T.StringType()),
    T.StructField("geographicRestrictions", T.StringType()),
    T.StructField("targetType", T.StringType()),
    T.StructField("ethnicity", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("minAward", T.DoubleType()),
    T.StructField("maxAward", T.DoubleType()),
    T.StructField("renewable", T.BooleanType()),
    T.StructField("country", T.StringType()),
    T.StructField("applyUrl", T.StringType()),
    T.StructField("isActive", T.BooleanType()),
    T.StructField("essayRequired", T.BooleanType()),
    T.StructField("recommendationsRequired", T.BooleanType()),
    T.StructField("source", T.StringType()),
    T.StructField("jobId", T.StringType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("updatedAt", T.StringType()),
    T.StructField("srcSeq", T.LongType()),
])

CRAWL_RESULT = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("timestamp", T.StringType()),
    T.StructField("metadata", T.StructType([
        T.StructField("statusCode", T.IntegerType()),
        T.StructField("loadTime", T.DoubleType()),
        T.StructField("wordCount", T.IntegerType()),
    ])),
])

SEARCH_CONFIG = T.StructType([
    T.StructField("searchTerms", T.ArrayType(T.StringType())),
    T.StructField("maxResultsPerTerm", T.IntegerType()),
    T.StructField("delayBetweenRequests", T.IntegerType()),
    T.StructField("searchEngine", T.StringType()),
    T.StructField("includeNews", T.BooleanType()),
    T.StructField("includeForums", T.BooleanType()),
    T.StructField("dateRange", T.StringType()),
])

_TEXT = ["url", "description", "eligibility", "organization", "academic_level",
         "geographic_restrictions", "apply_url"]
_FLAGS = {"renewable": False, "is_active": True, "essay_required": False,
          "recommendations_required": False}

# What an absent (null, '' or 0) value becomes, per profile; None keeps null.
DEFAULTS = {
    "curate": {
        "name": "", "deadline": "", **dict.fromkeys(_TEXT, ""), "target_type": "both",
        "ethnicity": "unspecified", "gender": "unspecified", "min_award": 0, "max_award": 0,
        "country": "US", **_FLAGS,
    },
    "migrate_bulk": {
        "name": "", "deadline": None, **dict.fromkeys(_TEXT, ""), "target_type": None,
        "ethnicity": "", "gender": "", "min_award": None, "max_award": None,
        "country": "", **_FLAGS, "source": "",
    },
    "migrate_items": {
        "name": "", "deadline": None, **dict.fromkeys(_TEXT, None), "target_type": "both",
        "ethnicity": "unspecified", "gender": "unspecified", "min_award": 0, "max_award": 0,
        "country": "US", **_FLAGS, "source": None,
    },
}

# A row of the raw archive with the parts of its folder.
ARCHIVE = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("content", T.StringType()),
    *(T.StructField(c, T.StringType()) for c in ("scraper", "year", "month", "day")),
])
