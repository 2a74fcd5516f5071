import sys

from concordia.cli import main

sys.exit(main())
