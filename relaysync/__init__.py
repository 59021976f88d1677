"""relaysync: activity-stream synchronisation as Spark DataFrame operators.

Events table (or stream) in; requests, outcomes and triples tables out.
Every operator is a ``DataFrame -> DataFrame`` function built from Spark's
own expressions so Catalyst can prune, push down and pipeline it.
"""

from relaysync.settings import Settings

__all__ = ["Settings"]
