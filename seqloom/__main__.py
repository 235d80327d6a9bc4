import sys

from seqloom.jobs import main

sys.exit(main())
