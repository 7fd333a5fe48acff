"""Registered queries of this package, and the SQL of those that SQL can say."""

from __future__ import annotations

from convoloom.llm import conversations, language, packing, pairs, personal, survivor, tokenise
from convoloom.llm.sql import SQL

QUERIES = {
    "p2_found": personal.p2_found,
    "p2_redacted": personal.p2_redacted,
    "p4_found": survivor.p4_found,
    "p4_consistent": survivor.p4_consistent,
    "p5_found": conversations.p5_found,
    "p5_conversations": conversations.p5_conversations,
    "p7_found": pairs.p7_found,
    "p8_ids": tokenise.p8_ids,
    "p9_windows": packing.p9_windows,
    "p9_fill": packing.p9_fill,
    "p10_found": language.p10_found,
    "p10_languages": language.p10_languages,
}

__all__ = ["QUERIES", "SQL"]
