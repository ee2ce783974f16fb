"""Reading: files against a contract, and files about themselves."""
