"""Translation of dbt projects into workspaces, by evaluating their templates statically."""
