"""Where tables come from: paths, storage options and transaction logs."""
