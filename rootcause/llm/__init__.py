"""Operators for preparing training corpora.

Nothing outside this subpackage imports it. General helpers of the library
(session, scratch folder) are imported from here, never the other way round.
"""
