"""The clock that the tests run by; a plain module, since any folder of tests may have a conftest of its own."""

import datetime as dt

AS_OF = dt.datetime(2026, 8, 25, 12, 0, 0)
