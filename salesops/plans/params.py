"""Parameters of the registered queries on the fixture tables.

The fixtures hold achievements up to 1998 and January 2024 todos, so the
report date is 1998-07-15 (a Wednesday) for the sales reports and
2024-01-17 (a Wednesday) for appointments; the ledger starts 1996-04-01.
The fixture's sales person ``Supplier#000000003`` is added to the exclusion
list so the exclusion is exercised.
"""

from __future__ import annotations

import datetime as _dt

from ..config import EXCLUDED_SALES_PERSONS, Config
from ..sources.fixtures import FIXTURE_EXCLUDED_SALES_PERSON

AS_OF = _dt.date(1998, 7, 15)
TODO_AS_OF = _dt.date(2024, 1, 17)
LEDGER_START = _dt.date(1996, 4, 1)
EXCLUDED_PERSONS = EXCLUDED_SALES_PERSONS + (FIXTURE_EXCLUDED_SALES_PERSON,)
VISIBLE_USER = "bh1"

CONFIG = Config(as_of=AS_OF, ledger_start=LEDGER_START, excluded_sales_persons=EXCLUDED_PERSONS)
TODO_CONFIG = CONFIG.with_(as_of=TODO_AS_OF)
