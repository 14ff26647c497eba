"""Where rows come from and go to: generators, benchmark records, report bundles."""
