"""Where documents come from: tables, files, archives of office documents."""
