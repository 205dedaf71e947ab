from .sources.cli import main

raise SystemExit(main())
