import sys

from strandline.cli import main

sys.exit(main())
