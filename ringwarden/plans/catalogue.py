"""Registered queries and their SQL."""

from ringwarden.plans import augmentation, calls, corpus, evaluation, preparation, reports, transcripts
from ringwarden.streaming import live, services, sessions

ENTRY = "top_suspected"
QUERIES = {**augmentation.QUERIES, **calls.QUERIES, **corpus.QUERIES, **evaluation.QUERIES, **reports.QUERIES, **preparation.QUERIES, **transcripts.QUERIES, **live.QUERIES, **sessions.QUERIES, **services.QUERIES}
ORACLES = {**augmentation.ORACLES, **calls.ORACLES, **corpus.ORACLES, **evaluation.ORACLES, **reports.ORACLES, **preparation.ORACLES, **transcripts.ORACLES, **live.ORACLES, **sessions.ORACLES, **services.ORACLES}
