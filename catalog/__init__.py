"""The queries of the driver contract and their SQL counterparts."""

from catalog.oracles import ORACLES
from catalog.queries import QUERIES
