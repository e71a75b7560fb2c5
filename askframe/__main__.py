from askframe.cli import main

raise SystemExit(main())
