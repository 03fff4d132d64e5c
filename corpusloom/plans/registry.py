"""All queries of the library's own operators and their SQL, by name."""

from corpusloom.plans import desk, drafts, gates, oracles, pronouns, queries, reading, shelf

PARTS = (drafts, gates, desk, shelf, pronouns, reading)
QUERIES, ORACLES = dict(queries.QUERIES), dict(oracles.ORACLES)
for _part in PARTS:
    if repeated := QUERIES.keys() & _part.QUERIES.keys():
        raise ValueError(f"queries of the same name: {repeated}")
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
