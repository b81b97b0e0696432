"""rootcause: complaint-theme triage and cohort diagnostics on Spark.

Reviews are curated, labelled with a complaint theme, ranked, and each theme is
diagnosed by a cohort join between support tickets and backend telemetry.
Everything is expressed with the DataFrame / SQL / Structured Streaming APIs.
"""

from rootcause.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
