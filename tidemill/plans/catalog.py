"""All queries of the core package and their SQL."""

from __future__ import annotations

from tidemill.plans import feed_queries, general_problems

flagship = feed_queries.flagship
QUERIES = {**feed_queries.QUERIES, **general_problems.QUERIES}
SQL = {**feed_queries.SQL, **general_problems.SQL}
