"""python -m tidewire"""

import sys

from tidewire.cli import main

sys.exit(main())
