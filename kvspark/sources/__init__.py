"""Where rows come from and go to: the table store, text and JSON imports, result sinks."""
