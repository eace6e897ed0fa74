"""Filters and projections."""

from pyspark.sql import functions as F

from pagestream.functions import text
from pagestream.sources.topics import RESULT_TOPICS

# Fixed value: a category text with one of these in it is maintenance, not topic.
NOISE = "Articles|articles|Wikidata|Noindexed|external|Pages|pages|CS1|AfD|AC|Stubs|stub"


def of_wiki(edits, wiki="enwiki"):
    return edits.where(F.col("wiki") == wiki)


def without_noise(edits, pattern=NOISE):
    """Drop categories that contain the pattern anywhere, case counts."""
    return edits.where(~F.col("categoryText").rlike(pattern))


def edits_only(events, kind="edit"):
    """Events of one type, as `event_id, timestamp, wiki, title`."""
    return events.where(F.col("e.type") == kind).select(
        F.col("e.id").alias("event_id"), "e.timestamp", "e.wiki", "e.title"
    )


def visible(categories):
    return categories.where(~F.col("hidden"))


def meaningful_terms(terms, column="term"):
    """Drop all-digit terms and the word that names the site."""
    term = F.col(column)
    return terms.where(~text.all_digits(term) & (term != "Wikipedia"))


def known_topics(messages, topics=RESULT_TOPICS):
    return messages.where(F.col("topic").isin(*topics))


def at_least(counts, threshold, column="value"):
    """The filter after an aggregation."""
    return counts.where(F.col(column) >= threshold)
