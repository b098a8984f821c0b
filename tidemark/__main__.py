import sys

from tidemark.app.cli import main

sys.exit(main())
