"""Column functions: everything here builds expressions, nothing runs a job."""
