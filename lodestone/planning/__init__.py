"""Rule-based planning: what a query asks for, which searches it becomes and where they go."""
