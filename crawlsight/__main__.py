import sys

from crawlsight.cli import main

sys.exit(main())
