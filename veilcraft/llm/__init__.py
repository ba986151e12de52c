"""Operators for large training corpora: each works on whole tables and on whole texts.

Nothing outside this folder imports it. Queries and their SQL are in :mod:`veilcraft.llm.catalog`.
"""
