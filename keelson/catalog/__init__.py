"""Every registered query with its SQL oracle."""

from keelson.catalog import fleet, integrity, logs, review, stored

QUERIES, ORACLES = {}, {}
for _module in (integrity, logs, review, stored, fleet):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
