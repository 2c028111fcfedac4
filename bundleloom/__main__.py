"""``python -m bundleloom``."""

import sys

from bundleloom.plans.cli import main

sys.exit(main())
