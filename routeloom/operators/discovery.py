"""Search items to seeds: which repositories to look at, and what their texts say of them.

Items have html_url, name, full_name, description, language, default_branch,
pushed_at, stargazers_count, forks_count, size, topics, owner.login,
license.spdx_id, archived, fork, private.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

REPOSITORY_URL = r"^https://github\.com/([^/]+)/([^/#?]+?)(?:\.git)?/?$"


def contains_any(text: Column, markers: list[str]) -> Column:
    # One pattern, so that the text's expression is there once and not once a marker.
    return text.rlike("|".join(re.escape(m) for m in markers))


def haystack(full_name: bool = True) -> Column:
    """Lower-cased name, full name if asked for, description and topics."""
    parts = ["name"] + ["full_name"] * full_name + ["description"]
    topics = F.array_join(F.coalesce("topics", F.expr("cast(array() as array<string>)")), " ")
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts], topics))


def included() -> Column:
    """Whether an item is a server or of the domain, and no fork, toy, library, tool or extension."""
    every, content = haystack(), haystack(full_name=False)
    name = F.lower(F.coalesce("name", F.lit("")))
    names = F.concat_ws(" ", name, F.lower(F.coalesce("full_name", F.lit(""))))
    flagged = reduce(or_, [F.coalesce(c, F.lit(False)) for c in ("archived", "fork", "private")])
    tool = contains_any(every, R.ACTION_MARKERS) | name.startswith("setup-") | (name == "cli") | name.endswith("-cli") | name.endswith("_cli")
    tool = tool | F.concat(F.lit(" "), every, F.lit(" ")).contains(" command line ")
    library = contains_any(every, R.SDK_MARKERS) | reduce(or_, [name.endswith(e) for e in R.LIBRARY_ENDINGS])
    other = contains_any(names, R.NAME_MARKERS) | contains_any(content, R.CONTENT_MARKERS) | contains_any(content, R.TOY_MARKERS)
    fits = F.coalesce(F.col("size") < R.MAX_REPOSITORY_KB, F.lit(True))
    return fits & ~flagged & ~tool & ~library & ~other & contains_any(every, R.SERVER_MARKERS + R.DOMAIN_MARKERS)


def category(every: Column) -> Column:
    found = T.first_marker(every, list(R.CATEGORY_MARKERS), F.lit(None))
    named = F.create_map(*[F.lit(x) for pair in R.CATEGORY_MARKERS.items() for x in pair])
    return F.coalesce(F.element_at(named, found), F.lit("api-candidate"))


def template(every: Column) -> Column:
    return F.when(contains_any(every, R.TEMPLATE_MARKERS), F.lit("metadata-indicator")).when(contains_any(every, R.SDK_MARKERS), F.lit("generated-sdk-suspect"))


def seeds(items: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Included items with a repository address, as seed rows; ``carry``: columns of the items that come along."""
    owner, name = (F.regexp_extract(F.trim("html_url"), REPOSITORY_URL, i) for i in (1, 2))
    rows = items.where(included() & F.col("html_url").rlike(REPOSITORY_URL)).withColumn("every_", haystack())
    every = F.col("every_")
    return rows.select(
        F.col("html_url").alias("repository_url"),
        owner.alias("owner"),
        name.alias("name"),
        "language",
        T.first_marker(every, R.FRAMEWORK_MARKERS, F.col("language")).alias("framework"),
        F.col("stargazers_count").alias("stars"),
        F.col("forks_count").alias("forks"),
        F.col("license.spdx_id").alias("license"),
        F.col("pushed_at").alias("last_activity"),
        "default_branch",
        category(every).alias("project_category"),
        template(every).alias("probable_template"),
        F.coalesce(F.col("owner.login"), owner).alias("vendor"),
        F.col("size").alias("size_kb"),
        F.slice("topics", 1, 20).alias("discovery_topics"),
        F.col("description").alias("discovery_description"),
        *(carry or []),
    )
