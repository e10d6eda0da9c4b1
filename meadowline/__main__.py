from meadowline.plans.cli import main

main()
