from spotweave.cli import main

raise SystemExit(main())
